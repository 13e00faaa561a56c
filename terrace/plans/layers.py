"""Layers made from the star schema, as DataFrames and as the same SQL: what the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.kernel import register, st


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as three levels of units."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.selectExpr(*ADMIN)


#: Columns of admin(), in SQL that both engines read.
ADMIN = (
    "c_custkey AS key",
    "concat('R', cast(r_regionkey as string)) AS adm1_code",
    "r_name AS adm1_name",
    "concat('R', cast(r_regionkey as string), lpad(cast(n_nationkey as string), 2, '0')) AS adm2_code",
    "n_name AS adm2_name",
    "concat('R', cast(r_regionkey as string), lpad(cast(n_nationkey as string), 2, '0'), lpad(cast(c_custkey as string), 6, '0')) AS adm3_code",
    "c_name AS adm3_name",
    "cast(c_acctbal as double) AS balance",
    "c_mktsegment AS segment",
)
ADMIN_SQL = f"SELECT {', '.join(ADMIN)} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

#: admin() with faults by the key: names first, then codes.
FAULTY = (
    "key",
    "adm1_code",
    "adm1_name",
    "adm2_code",
    "adm2_name",
    "CASE WHEN key % 37 = 0 THEN NULL WHEN key % 79 = 0 THEN concat('X', substr(adm3_code, 2)) WHEN key % 83 = 0 THEN concat(adm2_code, '999999') WHEN key % 89 = 0 THEN concat(adm3_code, 'Z') ELSE adm3_code END AS adm3_code",
    "CASE WHEN key % 41 = 0 THEN '' WHEN key % 43 = 0 THEN 'N/A' WHEN key % 47 = 0 THEN concat('Unit ', cast(key as string), '  ') WHEN key % 53 = 0 THEN 'Same Name' WHEN key % 59 = 0 THEN concat('CafÃ© ', cast(key as string))"
    " WHEN key % 61 = 0 THEN concat('Zero​Width ', cast(key as string)) WHEN key % 67 = 0 THEN concat('SHOUTED UNIT ', cast(key as string)) WHEN key % 71 = 0 THEN concat('Mосква ', cast(key as string))"
    " WHEN key % 73 = 0 THEN concat('Unit ', lower(adm2_code)) WHEN key % 97 = 0 THEN concat('Poste-', cast(key % 5 as string)) WHEN key % 101 = 0 THEN concat('póste ', cast(key % 5 as string)) WHEN key % 103 = 0 THEN concat('Poste ', cast(key % 5 as string)) ELSE concat('Unit ', cast(key as string)) END AS adm3_name",
)
FAULTY_SQL = f"SELECT {', '.join(FAULTY)} FROM ({ADMIN_SQL})"


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin(spark, sf_dir).selectExpr(*FAULTY)


#: Rows that stop above the finest level.
SHORT = (
    "key",
    "adm1_code",
    "adm1_name",
    "CASE WHEN key % 7 = 0 THEN NULL ELSE adm2_code END AS adm2_code",
    "CASE WHEN key % 7 = 0 OR key % 11 = 0 THEN NULL ELSE adm2_name END AS adm2_name",
    "CASE WHEN key % 7 = 0 OR key % 5 = 0 THEN NULL ELSE adm3_code END AS adm3_code",
    "CASE WHEN key % 7 = 0 OR key % 5 = 0 THEN NULL ELSE adm3_name END AS adm3_name",
)
SHORT_SQL = f"SELECT {', '.join(SHORT)} FROM ({ADMIN_SQL})"


def short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin(spark, sf_dir).selectExpr(*SHORT)


#: Nations as boxes on a grid of unit squares; customers as small boxes, each over one or several of them; and an earlier and a later version of the squares.
NATION_BOX = ("n_nationkey AS fid", "n_name AS name", "concat('N', cast(n_nationkey as string)) AS code", "cast(n_nationkey % 5 as double) AS xmin", "cast(n_nationkey / 5 as int) * 1.0D AS ymin", "n_nationkey % 5 + 1.0D AS xmax", "cast(n_nationkey / 5 as int) + 1.0D AS ymax")
_X, _Y = "(c_custkey * 37 % 997) / 200.0D", "(c_custkey * 53 % 991) / 200.0D"
CUSTOMER_BOX = ("c_custkey AS fid", "concat('N', cast(c_nationkey as string)) AS code", "concat('file', cast(c_custkey % 12 as string)) AS source_file", f"{_X} AS xmin", f"{_Y} AS ymin", f"{_X} + 0.05D + (c_custkey % 4) * 0.1D AS xmax", f"{_Y} + 0.05D + (c_custkey % 3) * 0.1D AS ymax")


#: Customers as L-shapes: a corner, a width and a height; both arms are 0.06 wide.
L_X, L_Y, L_W, L_H = "(c_custkey * 41 % 983) / 210.0D", "(c_custkey * 59 % 977) / 210.0D", "0.2D + (c_custkey % 7) * 0.1D", "0.15D + (c_custkey % 11) * 0.07D"


def _boxes(columns: tuple[str, ...], source: str) -> str:
    sql = ", ".join(columns).replace("cast(n_nationkey / 5 as int)", "cast(floor(n_nationkey / 5) as int)")
    return f"SELECT {sql} FROM {source}"


def duck(sql: str) -> str:
    """The same SQL with double literals as DuckDB writes them."""
    import re

    return re.sub(r"(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", sql)


NATION_SQL, CUSTOMER_SQL = duck(_boxes(NATION_BOX, "nation")), duck(_boxes(CUSTOMER_BOX, "customer"))


def nation_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(*(c.replace("cast(n_nationkey / 5 as int)", "cast(floor(n_nationkey / 5) as int)") for c in NATION_BOX))


def customer_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*CUSTOMER_BOX)


def customer_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    x, y, w, h = map(F.expr, (L_X, L_Y, L_W, L_H))
    low, side = st("makeenvelope", x, y, x + w, y + 0.06), st("makeenvelope", x, y + 0.06, x + 0.06, y + h)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fid"), st("union", low, side).alias("geom"))


# Suppliers as squares in a row of three, old and new: by the key kept, shifted, renamed, split in two, joined in pairs, gone, new or moved away.
_SX, _SY = "cast(s_suppkey % 100 * 3 as double)", "cast(floor(s_suppkey / 100) * 3 as double)"
OLD_BOX = ("s_suppkey AS fid", "concat('S', cast(s_suppkey as string)) AS code", "s_name AS name", f"{_SX} AS xmin", f"{_SY} AS ymin", f"{_SX} + 2.0D AS xmax", f"{_SY} + 2.0D AS ymax")
OLD_WHERE = "s_suppkey % 10 <> 6"
NEW_ROWS = (
    # (where, fid, code, x offset, width): up to two boxes for a supplier
    ("s_suppkey % 10 IN (0, 1, 2, 6, 7)", "s_suppkey * 10", "concat('S', cast(s_suppkey as string))", "0.0D", "2.0D"),
    ("s_suppkey % 10 = 3", "s_suppkey * 10", "concat('S', cast(s_suppkey as string))", "0.4D", "2.0D"),
    ("s_suppkey % 10 = 4", "s_suppkey * 10", "concat('S', cast(s_suppkey as string))", "0.0D", "1.0D"),
    ("s_suppkey % 10 = 4", "s_suppkey * 10 + 1", "concat('S', cast(s_suppkey as string), 'b')", "1.0D", "1.0D"),
    ("s_suppkey % 10 = 8", "s_suppkey * 10", "concat('T', cast(s_suppkey as string))", "0.0D", "5.0D"),
    ("s_suppkey % 10 = 9 AND s_suppkey % 3 = 0", "s_suppkey * 10 + 5", "concat('S', cast(s_suppkey as string))", "1.9D", "1.0D"),
)


def old_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where(OLD_WHERE).selectExpr(*OLD_BOX)


def _new(fid: str, code: str, dx: str, wide: str) -> tuple[str, ...]:
    return (f"{fid} AS fid", f"{code} AS code", "CASE WHEN s_suppkey % 10 = 2 THEN concat(s_name, ' II') ELSE s_name END AS name", f"{_SX} + {dx} AS xmin", f"{_SY} AS ymin", f"{_SX} + {dx} + {wide} AS xmax", f"{_SY} + 2.0D AS ymax")


def new_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, out = table(spark, sf_dir, "supplier"), None
    for where, *rest in NEW_ROWS:
        rows = s.where(where).selectExpr(*_new(*rest))
        out = rows if out is None else out.unionByName(rows)
    return out


OLD_SQL = duck(f"SELECT {', '.join(OLD_BOX)} FROM supplier WHERE {OLD_WHERE}")
NEW_SQL = duck(" UNION ALL ".join(f"SELECT {', '.join(_new(*rest))} FROM supplier WHERE {where}" for where, *rest in NEW_ROWS))
