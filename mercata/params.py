"""Job parameters: the dates and thresholds the analyst scripts declared up front.

Everything the reference derived from ``current_date()`` is derived here from an explicit
``as_of`` day, so a run is reproducible.  Two calendars exist in the supplied data: sales
(order lines, 1995-2001) and account events (January 2024); each job takes its dates from
the matching calendar.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

D = dt.date


def first_of_month(day: D) -> D:
    return day.replace(day=1)


def add_months(day: D, n: int) -> D:
    y, m = divmod(day.year * 12 + day.month - 1 + n, 12)
    return D(y, m + 1, 1)


def month_keys(start: D, stop: D) -> list[str]:
    """yyyyMM keys from the month of ``start`` to the month of ``stop`` (both included)."""
    out, cur = [], first_of_month(start)
    while cur <= stop:
        out.append(cur.strftime("%Y%m"))
        cur = add_months(cur, 1)
    return out


# ---------------------------------------------------------------- fixed values
# Values the reports depend on, stated once:
#   seller segments, in code order 1..4;
#   deal-count limit per segment for the quartile thresholds and the segment ladder (the analyst
#     used 5 / 10 / 15 / 30 deals per month on production volumes; the supplied tables have about
#     one deal per seller-month, so the same ladder is scaled to 1 / 1.5 / 2 / 3);
#   order types (B2B when the buyer account type is 'company');
#   account statuses that count as verified; the label of the all-categories grain;
#   the current-row marker of history tables.
SEGMENTS = ("small", "medium", "large", "VIP")
SEGMENT_DEAL_LIMITS = {"small": 1.0, "medium": 1.5, "large": 2.0, "VIP": 3.0}
ORDER_TYPES = ("B2B", "B2C")
COMPANY_ACCOUNT = "company"
VERIFIED_STATUSES = ("company", "ver")
TOTAL_LABEL = "Total"
CURRENT_ROW = "N"


@dataclass(frozen=True)
class TopOwnerParams:
    """Top-owner report (net GMV, ratings, ranks, pivots)."""

    date_start: D = D(2000, 8, 1)
    date_stop: D = D(2001, 8, 30)          # "yesterday" of the run
    rating_start: D = D(2024, 1, 1)        # ratings live on the account-event calendar
    rating_stop: D = D(2024, 1, 30)
    rating_recent_start: D = D(2024, 1, 16)
    min_rating_share: float = 0.75
    monthly_gmv_limit: float = 100_000.0
    min_months: int = 6

    @property
    def run_day(self) -> D:
        return self.date_stop + dt.timedelta(days=1)

    @property
    def last_day_of_month(self) -> D:
        return first_of_month(self.run_day) - dt.timedelta(days=1)

    @property
    def start_of_3_month_period(self) -> D:
        return first_of_month(self.last_day_of_month - dt.timedelta(days=65))

    @property
    def running_month(self) -> str:
        return self.date_stop.strftime("%Y%m")

    @property
    def pivot_months(self) -> list[str]:
        return month_keys(self.date_start, self.date_stop)

    @property
    def recent_months(self) -> list[str]:
        return month_keys(self.start_of_3_month_period, self.last_day_of_month)


@dataclass(frozen=True)
class SegmentationParams:
    date_from: D = D(2001, 1, 1)
    date_to: D = D(2001, 8, 30)
    yesterday: D = D(2001, 8, 30)
    deal_limits: tuple = tuple(SEGMENT_DEAL_LIMITS.items())
    quantile: float = 0.25

    @property
    def limits(self) -> dict[str, float]:
        return dict(self.deal_limits)


@dataclass(frozen=True)
class StatusParams:
    date_from: D = D(1996, 1, 1)
    date_to: D = D(2001, 10, 17)


@dataclass(frozen=True)
class AccountParams:
    sales_yesterday: D = D(2001, 8, 30)     # offers / GMV calendar
    events_yesterday: D = D(2024, 1, 30)    # consents / verified / users calendar
    gmv_days: int = 30
    gmv_open_from: D = D(2000, 9, 30)
    activity_day: D = D(2024, 1, 15)        # fixed snapshot day of the activity flags
    activity_month: int = 202401
    login_cutoff: str = "2024-01-20 00:00:00"
    login_never: str = "1900-01-01 00:00:00"


@dataclass(frozen=True)
class LedgerParams:
    owner: str = "3"
    date_from: D = D(2001, 7, 1)
    date_to: D = D(2001, 7, 31)


@dataclass(frozen=True)
class FollowUpParams:
    fee_start: D = D(2024, 1, 1)
    fee_stop: D = D(2024, 1, 30)
    marketplace: str = "main"
    forecast_start: D = D(1997, 7, 1)
    forecast_stop: D = D(2001, 8, 31)


@dataclass(frozen=True)
class Params:
    top: TopOwnerParams = field(default_factory=TopOwnerParams)
    seg: SegmentationParams = field(default_factory=SegmentationParams)
    status: StatusParams = field(default_factory=StatusParams)
    acct: AccountParams = field(default_factory=AccountParams)
    ledger: LedgerParams = field(default_factory=LedgerParams)
    follow: FollowUpParams = field(default_factory=FollowUpParams)
