"""Contains-matching of search terms against names by an index of q-grams.

``name ILIKE '%term%'`` would be a nested loop over terms x names. Every name that contains a term also contains
each of the term's grams (three letters in a row), so it is enough to look among the names that have the rarest of them: a
posting table holds the distinct grams of each name, its counts tell which gram of a term is rarest, and
the names met there are checked against the whole term. A name makes no more postings than it has letters, however
many terms and lengths of terms there are. Terms with ``%`` or ``_`` (which act as wildcards; a backslash is a plain
character) are looked up by their longest plain piece; pieces of one or two letters have grams of that
length, and terms of wildcards only meet all names that are long enough.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.plans.materialize import fits_broadcast, materialize, size_metrics

Q = 3
SALTS = 32
_ANY = "\u0000"  # marks the key of terms that consist of wildcards only


def search_terms(*columns_of: tuple) -> DataFrame:
    """Distinct lower-cased terms from (DataFrame, column) pairs; NULL and empty ones are left out."""
    parts = [df.select(F.lower(c).alias("term")).filter(F.col("term") != "") for df, c in columns_of]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def grams(text, q):
    """All stretches of ``q`` letters of a text, an empty array for shorter ones."""
    n = F.length(text)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring(text, i, F.lit(q)))).otherwise(
        F.array().cast("array<string>"))


def _needles(terms):
    """``term, wild, gram``: the grams of each term's longest plain piece; one of them will be looked up."""
    pieces = F.transform(F.split("term", "[%_]"), lambda x: F.struct(F.length(x).alias("n"), x.alias("text")))
    piece = F.array_max(pieces)["text"]
    least = F.length(F.regexp_replace("term", "[^_]", ""))
    short = F.array(F.when(F.length(piece) > 0, piece).otherwise(F.concat(F.lit(_ANY), least.cast("string"))))
    return terms.select("term", F.col("term").rlike("[%_]").alias("wild"), F.explode(
        F.array_distinct(F.when(F.length(piece) >= Q, grams(piece, Q)).otherwise(short))).alias("gram"))


def postings(names: DataFrame, name: str, sizes=(Q,), floors=()) -> DataFrame:
    """All columns of ``names``, ``_low`` (the name in lower case) and ``gram``: one row for each distinct gram of a name.

    ``sizes`` are the lengths of grams (up to three of them, 1 to 3), ``floors`` the lengths for which names that are long
    enough get a posting of their own.
    """
    low = F.col("_low")
    anys = F.transform(F.filter(F.array(*map(F.lit, floors)).cast("array<int>"), lambda n: n <= F.length(low)),
                       lambda n: F.concat(F.lit(_ANY), n.cast("string")))
    found = names.filter(F.col(name).isNotNull()).withColumn("_low", F.lower(F.col(name)))
    return found.withColumn("gram", F.explode(F.array_distinct(F.concat(anys, *[grams(low, q) for q in sizes]))))


def pattern_matches(terms: DataFrame, names: DataFrame, name: str, salt_on: str) -> DataFrame:
    """All (term, row of ``names``) with ``name ILIKE %term%``; names keep their columns.

    The grams of the distinct terms and the postings of those grams are written once. When the terms' real size is
    small they are broadcast and names never shuffle; otherwise both sides shuffle on the gram, with the
    names of a hot gram spread over ``SALTS`` tasks by ``salt_on``.
    """
    any_key = F.col("gram").startswith(_ANY)
    needles, seen = materialize(
        _needles(terms),
        sizes=F.collect_set(F.when(~any_key, F.length("gram"))),
        floors=F.collect_set(F.when(any_key, F.substring("gram", 2, 9).cast("int"))),
        **size_metrics("term", "gram"),
    )
    small = fits_broadcast(seen)
    side = F.broadcast if small else (lambda df: df)
    # The floors are bounded by the longest stored name.
    rows = postings(names, name, sorted(seen["sizes"]), sorted(seen["floors"]))
    found = materialize(rows.join(side(needles.select("gram").distinct()), "gram", "left_semi"))
    counts = found.groupBy("gram").agg(F.count("*").alias("_n"))
    # A term with a gram that no name has matches nothing.
    rarest = needles.join(counts, "gram", "left").groupBy("term", "wild").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("gram").alias("gram"))).alias("least"))
    chosen = materialize(rarest.filter("least.n > 0").select("term", "wild", "least.gram"))
    if small:
        hits = found.join(F.broadcast(chosen), "gram")
    else:
        salted = chosen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(SALTS)).cast("int")).join(salted, ["gram", "_salt"])
    whole = F.expr(r"_low LIKE concat('%', replace(term, '\\', '\\\\'), '%')")
    return hits.filter(F.when(F.col("wild"), whole).otherwise(F.contains("_low", "term"))).select("term", *names.columns)


def first_per_term(matches: DataFrame, cap: int, id_col: str = "id") -> DataFrame:
    """At most ``cap`` matches per term, lowest ids first (pruned before the shuffle)."""
    order = Window.partitionBy("term").orderBy(id_col)
    return matches.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= cap).drop("_rn")


def pattern_join(terms: DataFrame, names: DataFrame, cap: int) -> DataFrame:
    """(term, id, name) for names that contain a term, at most ``cap`` per term."""
    hits = pattern_matches(terms, names.select("id", "name"), "name", "id")
    return first_per_term(hits, cap)
