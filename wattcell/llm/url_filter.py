"""Host and path rules for URLs as a sort-merge range join, with DataFrame functions only.

A host turns into a key with its labels reversed, each closed by a dot, so a host and all its
subdomains are one interval of keys: those from ``net.example.`` to before ``net.example/``. The starts
and ends of the rules' intervals cut the sorted keys into segments, and in each segment the same
nested rule hosts are active: the stack of the sweep, innermost first. URLs and cuts are swept in
key order; a URL takes the stack of the last cut before it, and of that the first rule whose path
starts its own.

The sweep is dealt by ranges of keys, found as quantiles of the URLs' keys. A range with many
rows, like that of one very common host, is split at random; its few cuts are repeated in each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattcell.session import materialize

RANGES = 64
ROWS_PER_PART = 200_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/ ? #`` with A-Z lower-cased, and from there up to ``? #``.

    Both are empty for a null url and one without ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _prefix(key: Column) -> Column:
    """The first seven bytes of a key as a number, in the order of the keys."""
    first = F.rpad(F.hex(F.substring(F.encode(key, "UTF-8"), 1, 7)), 14, "0")
    return F.conv(first, 16, 10).cast("long")


def cuts(rules: DataFrame) -> DataFrame:
    """``cut, stack``: where segments of keys begin, and the rules active there, innermost first.

    ``rules`` has ``host, path, verdict``. Rules with a null host or path are ignored; of equal rules
    with both verdicts ``block`` counts.
    """
    named = rules.where("host IS NOT NULL AND path IS NOT NULL")
    named = named.select(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), "path", "verdict")
    named = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.struct(
        (-F.length("host")).alias("h"), (-F.length("path")).alias("p"), F.concat("host", "path").alias("rule"), "path", "verdict"
    )
    hosts = named.select(host_key(F.col("host")).alias("key"), rule.alias("r")).groupBy("key").agg(F.collect_list("r").alias("own"))
    labels = F.split(F.substring("key", F.lit(1), F.length("key") - 1), r"\.")
    outer = hosts.select("key", labels.alias("labels"))
    depth = F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("depth")
    outer = outer.select("key", "labels", depth)
    outer = outer.select("key", F.concat(F.array_join(F.slice("labels", 1, F.col("depth")), "."), F.lit(".")).alias("outer"))
    chain = outer.join(hosts.select(F.col("key").alias("outer"), "own"), "outer")
    flat = lambda c: F.sort_array(F.flatten(F.collect_list(c)))
    inner = F.when(F.col("outer") != F.col("key"), F.col("own"))
    stacks = chain.groupBy("key").agg(flat("own").alias("inside"), flat(inner).alias("outside"))
    start = stacks.select(F.col("key").alias("cut"), F.col("inside").alias("stack"))
    end = F.concat(F.substring("key", F.lit(1), F.length("key") - 1), F.lit("/"))
    return start.unionByName(stacks.select(end.alias("cut"), F.col("outside").alias("stack")))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    ranges: int = RANGES,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """``id, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and all subdomains where the url's path starts with the rule's path. The
    rule with the longest host wins, then the one with the longest path; ``rule`` is its host and path, null
    where none fits and ``default`` is the verdict. Rows repeat as they come, ids may be null.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("at", _prefix(F.col("key")))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = urls.agg(F.percentile_approx("at", steps, 1000)).first()[0] or []  # at most `ranges` numbers
    bounds = sorted(set(bounds))

    def dealt(rows: DataFrame, key: Column) -> DataFrame:
        steps = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
        return rows.withColumn("range", F.size(F.filter(steps, lambda b: b <= key)))

    urls = dealt(urls, F.col("at"))
    sizes = urls.groupBy("range").agg(F.ceil(F.count("*") / F.lit(rows_per_part)).cast("int").alias("parts"))
    parts = {r["range"]: r["parts"] for r in sizes.collect()}  # at most `ranges` rows
    split = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else F.create_map(F.lit(0), F.lit(1))
    salt = F.pmod(F.xxhash64("id", "key", "path"), split[F.col("range")]).cast("int")
    urls = urls.select("range", salt.alias("part"), "key", F.lit(1).alias("kind"), "id", "host", "path")

    marks = materialize(dealt(cuts(rules), _prefix(F.col("cut"))), "cuts")
    # The stack that is active where a range begins comes from the last cut in an earlier range.
    last = marks.groupBy("range").agg(F.max_by("stack", "cut").alias("stack"), F.max("cut").alias("cut"))
    here = pages.sparkSession.range(1).select(F.explode(split).alias("range", "parts"))
    here = here.where("parts > 0").select("range", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).alias("h")
    before = here.join(F.broadcast(last.alias("l")), F.col("l.range") < F.col("h.range"))
    before = before.groupBy("h.range", "h.part").agg(F.max_by("l.stack", "l.cut").alias("stack"))
    stack_type = marks.schema["stack"].dataType
    none = [F.lit(None).cast(t).alias(c) for c, t in (("id", urls.schema["id"].dataType), ("host", "string"), ("path", "string"))]
    opening = before.select("range", "part", F.lit("").alias("key"), F.lit(-1).alias("kind"), *none, "stack")
    inside = here.join(marks.alias("m"), F.col("m.range") == F.col("h.range"))
    inside = inside.select("h.range", "h.part", F.col("m.cut").alias("key"), F.lit(0).alias("kind"), *none, "m.stack")
    events = urls.withColumn("stack", F.lit(None).cast(stack_type)).unionByName(opening).unionByName(inside)

    sweep = W.partitionBy("range", "part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fit = F.get(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    swept = swept.withColumn("fit", fit)
    return swept.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.lit(default)).alias("verdict"),
    )
