"""Values the front end computes from query results, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.functions.numbering import number_globally
from faultloom.functions.scoring import count_where
from faultloom.operators import dashboard
from faultloom.session import stored


def customer_totals(w, limit: int = 50) -> DataFrame:
    return dashboard.customer_overview(w, limit).agg(
        F.count("*").alias("customers"), F.sum("vehicle_count").alias("total_vehicles"),
        F.sum("active_fault_vehicles").alias("total_active"), F.sum("critical_fault_vehicles").alias("total_critical"),
        F.coalesce(F.avg("avg_health_score"), F.lit(0.0)).alias("avg_score"))


def maintenance_buckets(w, limit: int = 30, customer: str | None = None) -> DataFrame:
    level = F.col("severity_level")
    return dashboard.maintenance_recommendations(w, limit, customer).agg(
        count_where(level >= 3).alias("critical"), count_where(level == 2).alias("moderate"),
        count_where(level <= 1).alias("low"))


def relative_to_max(df: DataFrame, col: str, out: str = "share_of_max") -> DataFrame:
    """Value over the column's maximum (at least 1). The maximum is a scalar
    sub-query, not a window over the whole table in one task."""
    top = df.select(F.max(F.col(col).cast("double"))).scalar()
    return df.withColumn(out, F.col(col) / F.greatest(F.coalesce(top, F.lit(1.0)), F.lit(1.0)))


def _identity(col: str) -> F.Column:
    return F.lower(F.trim(F.coalesce(F.col(col).cast("string"), F.lit(""))))


def alias_map(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """(identity, original, alias): names that differ only in case or outer
    blanks share an alias; aliases are numbered in sorted order of identity."""
    named = df.select(_identity(col).alias("identity"), F.trim(F.col(col).cast("string")).alias("original"))
    distinct = named.filter("identity <> ''").groupBy("identity").agg(F.min("original").alias("original"))
    return number_globally(distinct, "identity").select(
        "identity", "original", F.concat(F.lit(prefix), F.col("rn").cast("string")).alias("alias"))


def pseudonymise(df: DataFrame, col: str, prefix: str, aliases: DataFrame | None = None) -> DataFrame:
    """``df`` with ``col`` replaced by its alias; an empty value stays empty."""
    aliases = alias_map(df, col, prefix) if aliases is None else aliases
    lookup = aliases.select(F.col("identity").alias("_id"), F.col("alias").alias("_alias"))
    return (
        df.withColumn("_key", _identity(col)).join(lookup, F.col("_key") == F.col("_id"), "left")
        .withColumn(col, F.coalesce("_alias", F.lit(""))).select(*df.columns)
    )


ALIAS_WORD = "vehicle"


def _may_be_in_alias(query: str) -> bool:
    """Whether some alias (word and number) can contain the query."""
    head = query.rstrip("0123456789")
    return head in ALIAS_WORD if head == query else ALIAS_WORD.endswith(head)


def search_vehicles(w, customer: str, text: str, limit: int = 20) -> DataFrame:
    """Vehicles of a customer whose number or alias contains the text."""
    query = text.strip().lower()
    vehicles = dashboard.customer_vehicles(w, customer)
    hit = F.lower("vehicle_number").contains(query)
    if len(query) < 3:
        hit = F.lit(False)
    elif _may_be_in_alias(query):
        # numbering all vehicles is worth it only where an alias can match
        aliases = alias_map(w.vhs, "uniqueid", ALIAS_WORD).select(F.col("identity").alias("_id"), "alias")
        vehicles = vehicles.join(aliases, _identity("uniqueid") == F.col("_id"), "left")
        hit = hit | F.coalesce("alias", F.lit("")).contains(query)
    return vehicles.filter(hit).select("uniqueid", "vehicle_number").orderBy("vehicle_number", "uniqueid").limit(int(limit))


def top_active_faults(w, uniqueid: str, days: int = 90, limit: int = 5) -> DataFrame:
    return dashboard.vehicle_faults(w, uniqueid, days).filter("active_episodes > 0").orderBy(
        F.desc("active_episodes"), F.desc("max_severity"), F.desc("episode_count"), "dtc_code").limit(int(limit))


WINDOW = 1024
#: Names are looked up by their first characters, as many as the largest of these that the name has.
KEY_LENGTHS = (64, 32, 16, 8, 4, 2, 1)


#: Most beginnings of names that are looked up without dealing the places of the texts; a few MB.
FEW_KEYS = 200_000


def _found(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The names that occur in each text (id, low), as an array per id.

    Texts are cut into overlapping windows, so a long one is spread over rows.
    Every place of a window gives a hash of its next characters for each key
    length that some name has. Where names begin so, the place is cut to the
    lengths of these names, and what was cut meets the names in an equi-join:
    how many names begin alike does not count. A hash that two beginnings or
    two windows share costs a look, as whole names are compared in the end.
    """
    length = F.length("identity")
    size = F.coalesce(*[F.when(length >= n, F.lit(n)) for n in KEY_LENGTHS])
    names = names.filter(length > 0).distinct()
    begin = stored(names.groupBy(size.alias("size"), F.xxhash64(F.substring("identity", F.lit(1), size)).alias("key")).agg(
        F.collect_set(length).alias("lengths")))
    seen = begin.agg(F.count("*"), F.collect_set("size"), F.max(F.array_max("lengths"))).first()
    begins, sizes, longest = seen[0], sorted(seen[1]), seen[2] or 1
    starts = F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1)), F.lit(WINDOW))
    windows = texts.select("id", F.posexplode(F.transform(
        starts, lambda i: F.substring("low", i, F.lit(longest + WINDOW - 1)))).alias("w", "part")).select(
            F.xxhash64("id", "w").alias("window"), "id", "part")
    places = windows.select("window", "part", F.explode(
        F.sequence(F.lit(1), F.greatest(F.least(F.length("part"), F.lit(WINDOW)), F.lit(1)))).alias("at"))
    keys = [F.struct(F.lit(n).alias("size"), F.xxhash64(F.substring("part", F.col("at"), F.lit(n))).alias("key")) for n in sizes or [1]]
    keyed = places.select("window", "at", F.explode(F.array(*keys)).alias("k")).select("window", "at", "k.*")
    hits = keyed.join(F.broadcast(begin) if begins <= FEW_KEYS else begin, ["size", "key"]).select("window", "at", F.explode("lengths").alias("n"))
    cut = hits.join(windows, "window").select("id", F.substring("part", F.col("at"), F.col("n")).alias("identity")).distinct()
    return cut.join(names, "identity").groupBy("id").agg(F.collect_list(F.struct("identity", "alias", "kind")).alias("found"))


def mask_text(df: DataFrame, text_col: str, customers: DataFrame, vehicles: DataFrame, out: str = "masked") -> DataFrame:
    """Replace known names in free text by aliases: customers, then vehicles,
    longest name first, in any letter case.

    ``customers`` and ``vehicles`` are alias maps. The names to replace are
    those that occur in the text as given.
    """
    named = lambda m, kind: m.select("identity", "alias", F.lit(kind).alias("kind"))
    names = named(customers, 0).unionByName(named(vehicles, 1))
    # a digest stands for the text wherever rows move
    texts = df.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").select(
        F.sha2("text", 256).alias("id"), "text").groupBy("id").agg(F.min("text").alias("text"))
    found = _found(texts.select("id", F.lower("text").alias("low")), names)
    order = lambda n: F.struct(n["kind"], -F.length(n["identity"]), n["identity"], n["alias"])
    steps = F.array_sort(F.transform("found", lambda n: F.struct(
        order(n).alias("o"), n["identity"].alias("identity"), n["alias"].alias("alias"))))
    # the name as a literal pattern, whatever characters it holds
    literal = lambda name: F.concat(
        F.lit("(?iu)\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    masked = F.aggregate(
        steps, F.col("text"), lambda acc, n: F.regexp_replace(acc, literal(n["identity"]), n["alias"]))
    lookup = texts.join(found, "id", "left").select(F.col("id").alias("_id"), F.coalesce(masked, F.col("text")).alias(out))
    return df.withColumn("_key", F.sha2(F.col(text_col), 256)).join(lookup, F.col("_key") == F.col("_id"), "left").drop("_key", "_id")
