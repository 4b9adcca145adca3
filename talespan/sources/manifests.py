"""Lists and manifests: group lists, flat YAML manifests read and written, difference files, results not yet written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_list(spark: SparkSession, path: str) -> DataFrame:
    """pos and group of a list with one group a line; blank lines are left out."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "grp")).where("grp <> ''")


def plain_value(value: Column) -> Column:
    """A YAML scalar as text: quotes taken off, null for nothing, null and ~."""
    v = F.btrim(value, F.lit(" \t\r"))
    single = F.replace(F.regexp_extract(v, r"^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    double = F.replace(F.replace(F.regexp_extract(v, r'^"(.*)"$', 1), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(v.isin("", "null", "~"), None).when(v.rlike(r"^'.*'$"), single).when(v.rlike(r'^".*"$'), double).otherwise(F.regexp_replace(v, r"\s+#.*$", ""))


def entries(texts: DataFrame, key: str, text: str = "value") -> DataFrame:
    """(key, section, entry, fields) of manifests: lists of flat mappings under a name, as map<string,string>.

    Comments and blank lines are left out; a later field of an entry wins over an earlier one of the same name.
    """
    w = W.partitionBy(key).orderBy("line_no")
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(~F.col("line").rlike(r"^\s*(#.*)?$"))
    section = F.regexp_extract("line", r"^([A-Za-z_]\w*):\s*$", 1)
    rows = lines.withColumns({"section": F.last(F.when(section != "", section), True).over(w), "entry": F.count_if(F.col("line").rlike(r"^\s*- ")).over(w)}).where(section == "")
    field = F.struct(F.col("line_no"), F.regexp_extract("line", r"^[\s-]*([\w ]+):(\s|$)", 1).alias("name"), plain_value(F.regexp_extract("line", r"^[\s-]*[\w ]+:(.*)$", 1)).alias("value"))
    fields = rows.select(key, "section", "entry", field.alias("f")).where("f.name <> ''")
    last = fields.groupBy(key, "section", "entry", "f.name").agg(F.max("f")["value"].alias("value"))
    return last.groupBy(key, "section", "entry").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("fields"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """`entries` of files."""
    return entries(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), "file")


def entry_text(columns: list[str]) -> Column:
    """A row as an entry of a YAML list, fields by name; texts that would read as something else are quoted."""
    plain = r"^[A-Za-z][\w .()-]*$"
    shown = lambda c: F.when(F.col(c).isNull(), "null").when(F.col(c).cast("string").rlike(plain) & ~F.lower(F.col(c).cast("string")).isin("null", "true", "false", "yes", "no", "on", "off", "y", "n"), F.col(c).cast("string")).otherwise(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")))
    fields = [F.concat(F.lit("- " if i == 0 else "  "), F.lit(f"{c}: "), shown(c)) for i, c in enumerate(sorted(columns))]
    return F.concat_ws("\n", *fields)


def write_manifest(rows: DataFrame, path: str, order: str) -> None:
    """Rows in order as YAML lists, a file for each range of the order; numbers are quoted texts."""
    rows.orderBy(order).select(entry_text(rows.columns)).write.mode("overwrite").text(path)


def difference_lines(pairs: Column) -> Column:
    """`gold | heard` lines of pairs of word lists."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.array_join(p["gold"], " "), F.lit("\t|\t"), F.array_join(p["heard"], " "))), "\n")


def write_differences(rows: DataFrame, path: str, key: str, pairs: str = "pairs") -> None:
    """A folder for each key with its difference lines; only the keys at hand are replaced."""
    rows.select(key, difference_lines(F.col(pairs)).alias("value")).write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def write_results(results: DataFrame, done: DataFrame, path: str, key: str = "file") -> None:
    """Results as JSON, a folder for each file, without those that are written already; a second run adds nothing."""
    results.join(done.select(key).distinct(), key, "left_anti").write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def plain_date(text: Column) -> Column:
    """A date of the form YYYY-MM-DD; null for anything else, a day that no calendar has included."""
    return F.when(F.btrim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.btrim(text).try_cast("date"))
