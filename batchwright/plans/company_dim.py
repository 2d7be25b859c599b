"""The company dimension job (flagship).

Semantics of the production statement it replaces:

1. ``filtered_base``: base rows with ``company_type_code = '01'``.
2. ``dedup_mid``: mapping rows whose two ids are present, deduplicated to the
   latest row per ``v2_company_id`` (update_time, insert_time, dwi_company_id,
   all descending).  This dedup does not see the base filter.
3. inner join base.company_id = mid.v2_company_id.
4. every output cast to STRING, with renames, a NULL ``key_no``, the concat
   ``regist_capi``, the load stamp and the ``isadd`` change flag.
5. deduplicate again on the target key ``dwi_company_id`` (base update_time,
   insert_time, company_id descending) and keep the 28 columns in order.

Plan shape (see ``explain``): parquet scans with pushed filters and pruned
columns; dedup 2 and dedup 5 run as WindowGroupLimit (partial before the
shuffle, final after); the join reuses the hash partitioning of ``dedup_mid``
on the join key, so only the base side is exchanged for it.  AQE may turn the
join into a broadcast when the filtered base turns out small at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.functions.columns import change_flag, has_key, load_stamp, null_as
from batchwright.operators.dedup import latest_by
from batchwright.plans.standins import company_base, company_mapping
from batchwright.sources.tables import load

# Output columns of the target table, in insert order.
OUTPUT_COLUMNS = [
    "key_no", "company_id", "company_name", "oper_key_no", "oper_name", "regist_capi",
    "regist_capi_value", "regist_capi_unit", "rec_cap", "status", "start_date", "end_date",
    "credit_code", "no", "econ_kind", "econ_kind_code", "check_date", "belong_org",
    "province_code", "province", "term_start", "term_end", "address", "scope",
    "phone_number", "updated_date", "dates", "isadd",
]

# Fixed values: (base column, output name) for the plain string casts.
BASE_CASTS = [
    ("company_name", "company_name"), ("oper_key_no", "oper_key_no"),
    ("oper_name", "oper_name"),
    ("regist_capi", "regist_capi_value"), ("regist_capi_curr_name", "regist_capi_unit"),
    ("rec_capi", "rec_cap"), ("company_status_name", "status"),
    ("start_date", "start_date"), ("end_date", "end_date"), ("credit_code", "credit_code"),
    ("no", "no"), ("econ_kind", "econ_kind"), ("econ_kind_code", "econ_kind_code"),
    ("check_date", "check_date"), ("belong_org", "belong_org"),
    ("province_code", "province_code"), ("province_name", "province"),
    ("term_start", "term_start"), ("term_end", "term_end"), ("address", "address"),
    ("scope", "scope"), ("phone_number", "phone_number"), ("update_time", "updated_date"),
]


def dedup_mapping(mid: DataFrame) -> DataFrame:
    """Step 2: present ids only, latest row per v2_company_id."""
    return latest_by(
        mid.filter(has_key("dwi_company_id", "v2_company_id")),
        keys=["v2_company_id"],
        order=[F.col("update_time").desc_nulls_last(), F.col("insert_time").desc_nulls_last(),
               F.col("dwi_company_id").desc_nulls_last()],
    )


def build(base: DataFrame, mid: DataFrame, as_of: str | None = None) -> DataFrame:
    b = base.filter(F.col("company_type_code") == F.lit("01")).alias("base")
    m = dedup_mapping(mid).alias("mid")
    joined = b.join(m, F.col("base.company_id") == F.col("mid.v2_company_id"), "inner")
    transformed = joined.select(
        null_as("string").alias("key_no"),
        F.col("mid.dwi_company_id").cast("string").alias("company_id"),
        F.concat(F.col("base.regist_capi").cast("string"),
                 F.col("base.regist_capi_curr_name").cast("string")).alias("regist_capi"),
        *[F.col(f"base.{src}").cast("string").alias(dst) for src, dst in BASE_CASTS],
        load_stamp(as_of).alias("dates"),
        change_flag(F.col("base.is_del"), F.col("base.insert_time"), F.col("base.update_time")).alias("isadd"),
        # helper columns for the target-key dedup, dropped by the final projection
        F.col("base.update_time").alias("_upd"),
        F.col("base.insert_time").alias("_ins"),
        F.col("base.company_id").alias("_cid"),
    )
    deduped = latest_by(
        transformed, keys=["company_id"],
        order=[F.col("_upd").desc_nulls_last(), F.col("_ins").desc_nulls_last(),
               F.col("_cid").desc_nulls_last()],
    )
    return deduped.select(*OUTPUT_COLUMNS)


def company_dim(spark: SparkSession, sf_dir: str, as_of: str | None = None) -> DataFrame:
    """Whole job over the stand-in tables (orders as base, lineitem as mapping)."""
    return build(company_base(load(spark, sf_dir, "orders")),
                 company_mapping(load(spark, sf_dir, "lineitem")), as_of)
