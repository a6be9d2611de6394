"""Schemas of the records that the jobs exchange, as DDL."""

PAGE_LOG = """common struct<mid:string,vc:string,ch:string,ar:string,is_new:string>,
page struct<page_id:string,last_page_id:string,item:string,during_time:bigint>,
start map<string,string>, displays array<struct<item:string,item_type:string>>, ts bigint"""

ORDER_INFO = """id bigint, province_id bigint, order_status string, user_id bigint, total_amount decimal(16,2),
activity_reduce_amount decimal(16,2), coupon_reduce_amount decimal(16,2), original_total_amount decimal(16,2),
feight_fee decimal(16,2), expire_time string, create_time string, operate_time string, create_date string,
create_hour string, create_ts bigint"""

ORDER_DETAIL = """id bigint, order_id bigint, sku_id bigint, order_price decimal(16,2), sku_num bigint, sku_name string,
create_time string, split_total_amount decimal(16,2), split_activity_amount decimal(16,2),
split_coupon_amount decimal(16,2), create_ts bigint"""

PAYMENT_INFO = """id bigint, order_id bigint, user_id bigint, total_amount decimal(16,2), subject string,
payment_type string, create_time string, callback_time string, create_ts bigint"""

CHANGE = "table string, type string, data map<string,string>"

ROUTES = """source_table string, operate_type string, sink_type string, sink_table string, sink_columns string,
sink_pk string, sink_extend string"""
