"""Checks of names: missing, shared, damaged and odd ones; and their safe repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions import text
from terrace.functions.hierarchy import Target, levels_of
from terrace.operators.reports import any_of, finding, numbered, run_checks, severity
from terrace.operators.units import unit_list

# Severities, shares and lengths.
SEVERITY = {"check-failed": "error", "blank-name": "error", "placeholder-name": "error", "duplicate-name": "warn", "encoding-artifact": "error", "normalized-duplicate-name": "warn", "invisible-character": "warn", "unnormalized-unicode": "warn", "whitespace": "warn", "case-outlier": "warn", "mixed-script": "warn", "code-in-name": "warn"}
ROLLED = ("blank-name", "placeholder-name", "encoding-artifact", "invisible-character", "unnormalized-unicode", "whitespace", "mixed-script", "code-in-name")
REPAIRED = ("encoding-artifact", "invisible-character", "unnormalized-unicode", "whitespace")
FILLED_SHARE, MIXED_SHARE, LONG_CAPS, SHORT_CAPS, LEAST_CODE, ROLL_SHARE, ROLL_ROWS = 0.9, 0.9, 6, 3, 3, 0.5, 5
SCHEMA = T.StructType([T.StructField(n, T.IntegerType() if n == "level" else T.StringType()) for n in ("kind", "level", "name_column", "code_a", "name_a", "code_b", "name_b", "suggested", "reason")])


def _under(parent: Column) -> Column:
    return F.coalesce(parent, F.lit("the root"))


def name_findings(units: DataFrame) -> DataFrame:
    """All findings of a unit list, one for each unit or pair, before suppression and roll-up."""
    name = F.col("name")
    coded = units.where("code is not null")
    named = coded.where("name is not null and trim(name) <> ''")

    def each(kind: str, where: Column, reason: Column | str, suggested: Column | None = None) -> DataFrame:
        extra = {} if suggested is None else {"suggested": suggested}
        return finding(named.where(where), SCHEMA, kind, level="level", name_column="name_column", code_a="code", name_a="name", reason=F.lit(reason) if isinstance(reason, str) else reason, **extra)

    def first_column(rows: DataFrame) -> DataFrame:
        """Units that several language columns match count once, in the first."""
        return rows.withColumn("r", F.row_number().over(Window.partitionBy("level", "codes").orderBy("name_index"))).where("r = 1")

    def blank() -> DataFrame:
        share = units.groupBy("level", "name_column").agg(F.avg(F.coalesce(F.trim("name") != "", F.lit(False)).cast("int")).alias("share"))
        empty = F.coalesce(F.trim(F.regexp_replace(name, rf"\s|{text.INVISIBLE}", "")) == "", F.lit(True))
        rows = coded.join(F.broadcast(share), ["level", "name_column"]).where(empty & ((F.col("name_index") == 0) | (F.col("share") >= FILLED_SHARE)))
        return finding(rows, SCHEMA, "blank-name", level="level", name_column="name_column", code_a="code", name_a="name", reason=F.lit("no name"))

    def placeholder() -> DataFrame:
        low = F.lower(F.trim(name))
        return each("placeholder-name", low.isin(*text.PLACEHOLDERS) | (low == F.lower("code")) | ~name.rlike(r"[\p{L}\p{N}]"), "a placeholder, not a name")

    def duplicate() -> DataFrame:
        rows = named.groupBy("level", "name_column", "name_index", "parent_code", "name").agg(F.array_sort(F.collect_set("code")).alias("codes")).where("size(codes) > 1")
        return finding(first_column(rows), SCHEMA, "duplicate-name", level="level", name_column="name_column", code_a=F.get("codes", 0), name_a="name", code_b=F.get("codes", 1), name_b="name", reason=F.format_string("%d units under %s share this name: %s", F.size("codes"), _under(F.col("parent_code")), F.array_join("codes", ", ")))

    def alike() -> DataFrame:
        rows = named.withColumn("plain", text.unaccented(name)).withColumn("strict", text.squashed(F.lower(text.nfc(name))))
        rows = rows.withColumn("norm", F.when(text.letters_only_of(name, ("Latin",)), text.squashed(F.lower("plain"))).otherwise(F.col("strict"))).where("norm <> ''")
        unit = F.struct("code", "name")
        rows = rows.groupBy("level", "name_column", "name_index", "parent_code", "norm").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set(unit)).alias("units"), (F.count_distinct("strict") == 1).alias("one"), F.bool_or(F.col("name") == F.col("plain")).alias("plain"))
        rows = first_column(rows.where("size(codes) > 1 and size(names) > 1 and (one or plain)"))
        return finding(rows, SCHEMA, "normalized-duplicate-name", level="level", name_column="name_column", code_a=F.get("units", 0)["code"], name_a=F.get("units", 0)["name"], code_b=F.get("units", 1)["code"], name_b=F.get("units", 1)["name"], reason=F.format_string("%d units under %s have names that differ only in case, accents or punctuation: %s", F.size("codes"), _under(F.col("parent_code")), F.array_join("names", " / ")))

    def encoding() -> DataFrame:
        lost, fixed = name.contains("�"), text.repair(name)
        reason = F.when(lost, "contains U+FFFD, characters lost when the file was read").when(fixed.isNull(), "looks like text read with the wrong encoding, no safe repair").otherwise("text read with the wrong encoding")
        return each("encoding-artifact", lost | name.rlike(text.STRONG_MOJIBAKE) | (name.rlike(text.MOJIBAKE) & fixed.isNotNull()), reason, fixed)

    def case() -> DataFrame:
        words = F.filter(F.split(name, r"[^\p{L}]+"), lambda w: (w == F.upper(w)) & (w != F.lower(w)) & ~w.rlike(text.ROMAN))
        rows = named.where(text.letters_only_of(name, text.SCRIPTS)).withColumns({"upper": name.rlike(r"\p{Lu}"), "lower": name.rlike(r"\p{Ll}"), "caps": F.transform(words, F.length)})
        shouted = ~F.col("upper") | F.coalesce(F.array_max("caps") >= LONG_CAPS, F.lit(False)) | (F.size(F.filter("caps", lambda n: n >= SHORT_CAPS)) >= 2)
        rows = rows.withColumn("odd", (F.col("upper") != F.col("lower")) & name.rlike(rf"\p{{L}}{{{SHORT_CAPS + 1}}}") & shouted)
        share = rows.where((F.col("upper") & F.col("lower")) | F.col("odd")).groupBy("level", "name_column").agg(F.avg((~F.col("odd")).cast("int")).alias("mixed"))
        rows = rows.where("odd").join(F.broadcast(share.where(F.col("mixed") >= MIXED_SHARE)), ["level", "name_column"])
        reason = F.concat(F.when(F.col("upper"), "all capitals").otherwise("all lower case"), F.lit(" where the column is mixed case"))
        return finding(rows, SCHEMA, "case-outlier", level="level", name_column="name_column", code_a="code", name_a="name", reason=reason)

    def scripts() -> DataFrame:
        mixed = F.exists(F.split(name, r"[^\p{L}\p{M}]+"), lambda w: reduce(Column.__add__, (w.rlike(rf"\p{{Is{s}}}").cast("int") for s in text.SCRIPTS)) > 1)
        return each("mixed-script", mixed, f"a word mixes {'/'.join(text.SCRIPTS)} letters").distinct()

    def code_inside() -> DataFrame:
        def has(c: str) -> Column:
            inside = F.concat(F.lit(" "), text.tokens(name), F.lit(" ")).contains(F.concat(F.lit(" "), text.tokens(F.col(c)), F.lit(" ")))
            return F.coalesce((F.length(c) >= LEAST_CODE) & F.col(c).rlike(r"\p{L}") & F.col(c).rlike(r"\p{N}") & inside, F.lit(False))

        return each("code-in-name", (F.lower(F.trim(name)) != F.lower("code")) & (has("code") | has("parent_code")), "the name contains a code")

    checks = {
        "blank-name": blank,
        "placeholder-name": placeholder,
        "duplicate-name": duplicate,
        "encoding-artifact": encoding,
        "normalized-duplicate-name": alike,
        "invisible-character": lambda: each("invisible-character", name.rlike(f"{text.INVISIBLE}|{text.ODD_SPACE}"), "contains invisible characters or non-standard spaces", text.cleaned(name)),
        "unnormalized-unicode": lambda: each("unnormalized-unicode", F.length(text.nfc(name)) < F.length(name), "accents stored as separate characters (not NFC)", text.cleaned(name)),
        "whitespace": lambda: each("whitespace", name.rlike("^ | $|  "), "leading, trailing or repeated spaces", text.cleaned(name)),
        "case-outlier": case,
        "mixed-script": scripts,
        "code-in-name": code_inside,
    }
    return run_checks(checks, SCHEMA, units.sparkSession)


def suppressed(found: DataFrame) -> DataFrame:
    """Without single-unit findings that a blank name or an encoding error of the same unit explains."""
    unit = ["level", "name_column", "code_a"]
    blank = found.where("kind = 'blank-name'").select(*unit).distinct().withColumn("blank", F.lit(True))
    broken = found.where("kind = 'encoding-artifact'").select(*unit).distinct().withColumn("broken", F.lit(True))
    rows = found.join(blank, unit, "left").join(broken, unit, "left")
    hidden = F.col("code_b").isNull() & ((F.coalesce("blank", F.lit(False)) & (F.col("kind") != "blank-name")) | (F.coalesce("broken", F.lit(False)) & (F.col("kind") == "invisible-character")))
    return rows.where(~hidden).select(*SCHEMA.names)


def rolled_up(found: DataFrame, units: DataFrame) -> DataFrame:
    """A kind that hits most of a column is one row; a unit blank in several columns is one row."""
    where = ["level", "name_column"]
    totals = units.groupBy(*where).agg(F.count("*").alias("total"))
    hits = found.where(F.col("kind").isin(*ROLLED)).groupBy("kind", *where).agg(F.count("*").alias("n"), any_of("reason").alias("why")).join(totals, where)
    rolled = hits.where((F.col("n") >= ROLL_ROWS) & (F.col("n") > F.col("total") * ROLL_SHARE))
    rest = found.join(rolled, ["kind", *where], "left_anti").select(*SCHEMA.names)
    single = (F.col("kind") == "blank-name") & F.col("code_a").isNotNull()
    blanks = rest.where(single).groupBy("kind", "level", "code_a").agg(F.array_join(F.array_sort(F.collect_list("name_column")), ", ").alias("name_column"), any_of("reason").alias("reason"))
    whole = rolled.select(F.col("kind").alias("k"), "level", "name_column", F.format_string("%d of %d names in this column: %s", "n", "total", "why").alias("reason"))
    empty = lambda df, kind: df.select(*(F.col(kind).alias("kind") if f.name == "kind" else (F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)) for f in SCHEMA))
    return rest.where(~single).unionByName(empty(blanks, "kind")).unionByName(empty(whole, "k"))


def name_detect(layer: DataFrame, fields: Target = Target()) -> DataFrame:
    """The report of a layer's names: findings with key and severity."""
    units = unit_list(layer, fields).persist()  # every check reads it; small beside the layer
    found = suppressed(name_findings(units).persist()).persist()  # read by several steps each; findings are few beside the layer
    rows = rolled_up(found, units)
    rows = numbered(rows, ("level", "name_column", "code_a", "name_a")).withColumn("severity", severity(SEVERITY))
    return rows.select("key", "kind", "severity", *SCHEMA.names[1:])


def name_clean(layer: DataFrame, fields: Target = Target()) -> DataFrame:
    """layer with every name that a safe finding has a suggestion for replaced by it, never by an empty one."""
    out = {}
    for code, names in levels_of(layer.columns, fields).values():
        for c in names:
            old = F.col(c)
            fixed = text.cleaned(old)
            bad = old.rlike(f"{text.INVISIBLE}|{text.ODD_SPACE}") | old.rlike("^ | $|  ") | old.rlike(text.MOJIBAKE) | (F.length(text.nfc(old)) < F.length(old))
            out[c] = F.when(F.col(code).isNotNull() & bad & (fixed != ""), fixed).otherwise(old)
    return layer.withColumns(out)
