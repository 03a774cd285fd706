"""Declared schemas of the model tables and the conform step applied on read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    fields = [part.split(":") for part in text.split()]
    types = {
        "string": T.StringType(),
        "int": T.IntegerType(),
        "long": T.LongType(),
        "double": T.DoubleType(),
        "boolean": T.BooleanType(),
        "date": T.DateType(),
    }
    return T.StructType([T.StructField(name, types[kind]) for name, kind in fields])


CLIENTS = _schema(
    "id:string name:string age:int gender:string loyalty_card:boolean city:string"
)
PRODUCTS = _schema("id:string name:string category:string price:double cost:double")
STORES = _schema(
    "id:string name:string location:string capacity:int opening_hour:string closing_hour:string"
)
SALES = _schema(
    "sale_id:string nb_type_product:int product_id:string client_id:string store_id:string "
    "quantity:int sale_amount:double sale_time:string sale_date:date"
)
RETAIL_DATA = _schema(
    "store_id:string store_name:string hour:int visitors:int sales:int date:date"
)
# The output columns of the metrics table and their order.
TRAFFIC_METRICS = _schema(
    "date:date day_of_week:string store_id:string "
    "total_visitors:double avg_visitors_last_4_weeks:double "
    "visitors_variation_vs_avg_4w_percent:double "
    "total_transactions:long avg_sales_last_4_weeks:double "
    "transactions_variation_vs_avg_4w_percent:double "
    "total_quantity:long best_selling_product_id:string best_selling_product_name:string "
    "total_revenue:double avg_revenue_last_4_weeks:double "
    "revenue_variation_vs_avg_4w_percent:double "
    "total_cost:double total_margin:double conversion_rate:double "
    "avg_transaction_value:double transactions_amount_variation_vs_avg_4w_percent:double "
    "revenue_per_visitor:double margin_per_visitor:double "
    "peak_hour_sales:int peak_hour_visitors:int"
)

TABLES = {
    "clients": CLIENTS,
    "products": PRODUCTS,
    "stores": STORES,
    "sales": SALES,
    "retail_data": RETAIL_DATA,
}
PARTITION_COLUMN = {"sales": "sale_date", "retail_data": "date", "traffic_metrics": "date"}


def parse_date(column: Column) -> Column:
    """Strict ``yyyy-MM-dd`` text to date; anything else becomes null."""
    return F.try_to_date(column, "yyyy-MM-dd")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast what differs, add what is missing as null.

    Stored files disagree on some types: counts turn into floats where a day has gaps
    (NaN is such a gap), hours and dates may be text. A value that its declared type
    can't hold is an error, never a silent null.
    """
    columns = []
    for field in schema.fields:
        if field.name not in df.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        found, raw = df.schema[field.name].dataType, F.col(field.name)
        value = raw
        if isinstance(found, T.FractionalType) and isinstance(field.dataType, T.IntegralType):
            raw = F.when(~F.isnan(raw.cast("double")), raw)
            value = F.when(raw == F.floor(raw), raw.try_cast(field.dataType))
        elif isinstance(field.dataType, T.DateType) and isinstance(found, T.StringType):
            value = parse_date(raw)
        elif found != field.dataType:
            value = raw.try_cast(field.dataType)
        if value is not raw:
            misfit = F.concat(F.lit(f"{field.name} can't hold "), raw.cast("string"))
            value = F.when(raw.isNotNull() & value.isNull(), F.raise_error(misfit).cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return df.select(*columns)
