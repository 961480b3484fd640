"""The canonical views are the data model every job relies on: their columns and types are pinned
here, and each one yields rows on the smallest supplied scale factor."""

import pytest

from mercata.sources import views as V
from mercata.sources.tables import Tables

SF = "/root/testdata/sf0.001"

EXPECTED = {
    "sales": "deal_id:bigint,day:date,seller_id:bigint,offer_id:bigint,order_offer_id:bigint,category_id:bigint,"
             "price:decimal(18,2),quantity:int,returned:boolean,shipped_at:timestamp_ntz,buyer_id:bigint,"
             "buyingtime:timestamp_ntz",
    "order_headers": "order_offer_id:bigint,buyer_id:bigint,day:date",
    "refunds": "day:date,seller_id:bigint,order_id:bigint,offer_id:bigint,order_offer_id:bigint,category_id:bigint,"
               "refund_quantity:int,refunded_gmv:decimal(18,2),refund_finish_date:timestamp_ntz",
    "offers_by_category": "day:date,seller_id:bigint,category_leaf:bigint,offers:bigint",
    "offers_total": "day:date,seller_id:bigint,offers:bigint,offers_no_classifieds:bigint",
    "verified_sellers": "account_id:bigint,day:date",
    "verified_accounts": "account_id:bigint,day:date",
    "segment_monthly": "us_id:bigint,month_:int,segment:int",
    "category_tree": "ca_id_leaf:bigint,new_meta:string,new_ca_name_1:string",
    "owner_map": "ud_us_id:bigint,nip:string",
    "test_users": "us_id:bigint",
    "account_status_history": "cis_user_id:bigint,cis_status:string,cis_from_date:date,cis_historical:string",
    "users": "account_id:bigint,login:string,account_status:string,account_type:string,account_create_date:date,"
             "success_login_timestamp:timestamp_ntz",
    "account_type_history": "account_id:bigint,account_type:string,valid_from:date,valid_to:date",
    "consents": "day:date,userid:bigint,consentname:string,channel:string,approved:boolean",
    "net_gmv_daily": "dt:date,account_id:bigint,GMV_ref:decimal(18,2)",
    "ratings": "opponent_id:bigint,recommend:boolean,create_date:timestamp_ntz",
    "fees": "day:date,account_id:bigint,short_type:string,gross_amount:decimal(18,2),marketplace:string",
    "fee_types": "id:string,my_group_desc:string",
    "owner_list": "nip:string",
    "account_list": "us_id:bigint,list_segment:string,list_balance:double",
    "webinar_attendance": "id:bigint,account_name:string,webinar_title:string",
}


def _build(spark, name):
    t = Tables(spark, SF)
    special = {"sales": lambda: V.sales(t, with_buyer=True), "users": lambda: V.users(t, with_login=True),
               "fee_types": lambda: V.fee_types(spark)}
    return special[name]() if name in special else getattr(V, name)(t)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_view_schema_and_rows(spark, name):
    df = _build(spark, name)
    assert df.schema.simpleString()[len("struct<"):-1] == EXPECTED[name]
    assert df.limit(1).count() == 1
