"""Structured values out of text, with their addresses; markup attributes; template markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.shipping import cut_lineage, ship

#: Kinds of values. The patterns are ours, and use only what both regex dialects share.
PATTERNS = {
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "amount": r"[$€£][0-9]+(?:[.,][0-9]+)*",
    "number": r"[0-9]+",
    "quantity": r"[0-9]+ ?(?:kg|km|cm|mm|MB|GB|h)",
}


#: An anchor with its address in double quotes, whatever attributes stand before it and in any case of letters.
ANCHOR = r'(?i)<a\s(?:[^>]*\s)?href\s*=\s*"([^"]*)"'


def extract_values(paras: DataFrame, kinds: dict[str, str] = PATTERNS, id_col: str = "doc_id") -> DataFrame:
    """A row for each value: address, page, kind, ordinal within the paragraph and the value."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("values")) for k, p in kinds.items()])
    one = paras.filter(F.col("text").rlike("|".join(kinds.values()))).select(id_col, "section", "para", "page", F.explode(found).alias("f"))
    return one.select(id_col, "section", "para", "page", F.col("f.kind").alias("kind"), F.posexplode("f.values").alias("ordinal", "value"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, href) of all anchors in markup."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("ordinal", "href"))


def luhn_numbers(text: str | Column) -> Column:
    """The runs of 13 to 19 digits in text that pass the Luhn check."""
    name = text if isinstance(text, str) else "text"
    return F.expr(f"filter(regexp_extract_all({name}, '[0-9]+', 0), x -> length(x) BETWEEN 13 AND 19 AND luhn_check(x))")


def pii_counts(docs: DataFrame) -> DataFrame:
    """Detection only, never masking: counts by kind for every document."""
    found = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    t = F.col("text")
    # cheap tests first: most texts have none of these
    return docs.select(
        "doc_id",
        F.when(~t.contains("@"), 0).otherwise(found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+")).cast("long").alias("emails"),
        F.when(~t.rlike(r"[0-9]\.[0-9]"), 0).otherwise(found(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")).cast("long").alias("ips"),
        F.when(~t.rlike("[0-9]{13}"), 0).otherwise(F.size(luhn_numbers("text"))).cast("long").alias("cards"),
    )


def redact(text: Column, kinds: tuple[str, ...] = ("email", "ip", "digits")) -> Column:
    """Masks all kinds by default."""
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "digits": r"[0-9]{13,19}"}
    for k in kinds:
        text = F.regexp_replace(text, rules[k], f"[{k}]")
    return text


def dedup_names(names: list[str], taken: list[str]) -> list[str]:
    """Each name as it is if free, else with the first free suffix _2, _3, ...; earlier names count as taken."""
    used, out = set(taken), []
    for n in names:
        new, k = n, 2
        while new in used:
            new, k = f"{n}_{k}", k + 1
        used.add(new)
        out.append(new)
    return out


def dedup_field_names(fields: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """fields with unique_name: dedup_names() for each group of rows in order (ties: by name), without gathering a group.

    The j-th row of a name takes its j-th free number (1 is the bare name). A number is not free if a given name is spelt like
    it and comes before the row that would take it; and a bare name is not free if such a number was taken before. Names can only meet in
    that way, so both are decided together, by windows over the rows of a name, until nothing changes. Null names stay null; null groups
    are a group.
    """
    g = F.struct(F.col(group).alias("g"))
    whole = fields.withColumns({"_g": g, "_at": F.row_number().over(Window.partitionBy(group).orderBy(order, name))})
    whole = cut_lineage(whole, "names")
    ship(fields.sparkSession)
    rows = whole.filter(F.col(name).isNotNull()).select("_g", "_at", F.col(name).cast("string").alias("base"))
    rows = cut_lineage(rows.withColumn("j", F.row_number().over(Window.partitionBy("_g", "base").orderBy("_at")).cast("long")), "names-ranked")
    first = rows.filter("j = 1").select("_g", F.col("base").alias("spelt"), F.col("_at").alias("f"))
    parts = "^(?s)(.*)_([2-9]|[1-9][0-9]{1,17})$"
    like = first.filter(F.col("spelt").rlike(parts)).select("_g", F.regexp_extract("spelt", parts, 1).alias("base"), F.regexp_extract("spelt", parts, 2).cast("long").alias("k"), "spelt", "f")
    met = cut_lineage(like.join(rows.select("_g", "base").distinct(), ["_g", "base"]).withColumn("taken", F.lit(True)), "names-met")
    by = Window.partitionBy("_g", "base")

    def blocked(met: DataFrame) -> DataFrame:
        """(_g, base, k) of numbers that aren't free: those that given names took, and the bare ones of names that came too late."""
        return met.filter("taken").select("_g", "base", "k").union(met.filter("NOT taken").select("_g", F.col("spelt").alias("base"), F.lit(1).cast("long")))

    while True:
        every = met.select("_g", "base", "k", "spelt", "f", "taken", F.col("taken").cast("long").alias("n")).unionByName(met.filter("NOT taken").select("_g", F.col("spelt").alias("base"), F.lit(1).cast("long").alias("k"), F.lit(None).cast("string").alias("spelt"), F.lit(None).cast("int").alias("f"), "taken", F.lit(1).cast("long").alias("n")))
        below = F.coalesce(F.sum("n").over(by.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        asks = every.withColumn("j", F.col("k") - below).filter("spelt IS NOT NULL").join(rows.withColumnRenamed("_at", "q"), ["_g", "base", "j"], "left")
        new = cut_lineage(asks.select("_g", "base", "k", "spelt", "f", (F.col("q").isNull() | (F.col("f") < F.col("q"))).alias("taken"), F.col("taken").alias("was")), "names-met")
        met = new.drop("was")
        if new.filter("taken <> was").isEmpty():
            break
    taken = blocked(met).withColumn("free", F.col("k") - F.row_number().over(by.orderBy("k")))
    both = rows.select("_g", "base", "_at", "j", F.col("j").alias("v"), F.lit(0).alias("block")).unionByName(taken.select("_g", "base", F.lit(None).cast("int").alias("_at"), F.lit(None).cast("long").alias("j"), F.col("free").alias("v"), F.lit(1).alias("block")))
    skipped = F.sum("block").over(by.orderBy("v", "block").rowsBetween(Window.unboundedPreceding, 0))
    numbers = both.withColumn("k", F.col("j") + skipped).filter("block = 0").select("_g", "_at", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("k").cast("string"))).alias("unique_name"))
    return whole.join(numbers, ["_g", "_at"], "left").select(*fields.columns, "unique_name")


def template_schema(marks: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, block, fields) from field markers: the fields of each block sorted, top-level ones under ''."""
    return marks.groupBy(by, "block").agg(F.array_sort(F.collect_set("field")).alias("fields"))
