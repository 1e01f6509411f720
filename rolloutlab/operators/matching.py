"""Operator-name dictionary matching.

Two plan shapes for the same semantics:

* join form (J1-J3): op occurrences as rows, an equi join for exact names, and
  for the fuzzy pass, run on the *distinct unmatched names* only, an inverted
  index of character grams (a dictionary of proven small size is broadcast and
  scanned instead).
* row-local form (``reference_text``): the dictionary is a fixed table of at
  most a few hundred entries, so it is embedded in the expression as a literal
  map (exact) and a literal array (ordered fuzzy scan). Each sample row is
  resolved in place: no explode, no shuffle, no join back to the wide samples
  table. This is the default for J4.

Both give the same keys; ``tests/test_operators.py`` checks they agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloutlab.dictionaries import ARCH_JOIN, OP_DICTS, lit_map, lit_struct_array, snippet_rows


def _dim(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast a dimension table only when its size is proven small.

    The library's own dictionaries are fixed tables of under a hundred rows: its
    queries pass ``small=True``. By default no hint is given and adaptive
    execution picks broadcast at run time only if the measured size is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
    """
    return F.broadcast(df) if small else df


# ------------------------------------------------------------------ join form
def explode_ops(samples: DataFrame, id_col: str = "sample_id", ops_col: str = "ops") -> DataFrame:
    """(id, pos, op) per occurrence; order is kept as ``pos``."""
    return samples.select(id_col, F.posexplode(ops_col).alias("pos", "op"))


def match_exact(occ: DataFrame, dictionary: DataFrame, small: bool = False) -> DataFrame:
    """Left equi-join of op names (case-sensitive) to the dictionary; adds ``key``."""
    d = _dim(dictionary.select(F.col("map_op").alias("op"), "key"), small)
    return occ.join(d, "op", "left")


GRAM = 3


def _grams(text: str, length: int) -> str:
    return f"transform(sequence(1, length({text}) - {length - 1}), i -> substring({text}, i, {length}))"


def contained_pairs(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(s, t) for every text ``s`` of ``inner`` that stands in a text ``t`` of ``outer`` (distinct, not empty), through
    an inverted index of character grams.

    Every text of ``outer`` is listed under its grams of up to three characters; ``s`` is looked up under one gram only,
    the one of its own with the shortest list, and what is found there is compared."""
    every = " , ".join(f"IF(length(t) >= {n}, {_grams('t', n)}, array())" for n in range(1, GRAM + 1))
    index = outer.select("t", F.explode(F.expr(f"array_distinct(concat({every}))")).alias("gram"))
    lengths = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = inner.select("s", F.explode(F.expr(f"IF(length(s) < {GRAM}, array(s), array_distinct({_grams('s', GRAM)}))")).alias("gram"))
    # a gram that no text holds rules the text out: it has the shortest list, which is empty
    best = (own.join(lengths, "gram", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
            .where("g.n > 0").select("s", F.col("g.gram").alias("gram")))
    return best.join(index, "gram").where(F.contains("t", F.col("s"))).select("s", "t")


def match_fuzzy(occ: DataFrame, dictionary: DataFrame, small: bool = False) -> DataFrame:
    """For rows whose ``key`` is null, case-insensitive containment in either
    direction; the first dictionary entry in order wins.

    Only the distinct unmatched names are compared, and the result is joined
    back on the name. With ``small`` (a dictionary of proven small size) the names
    meet the broadcast dictionary; otherwise candidates come from an inverted
    index of character grams, once per direction, so no name meets every entry."""
    names = occ.where(F.col("key").isNull()).select("op").distinct()
    d = _dim(dictionary.select("ord", F.lower("map_op").alias("lop"), F.col("key").alias("fkey")), small)
    if small:
        lo = F.lower(F.col("op"))
        pairs = names.join(d, F.contains(lo, F.col("lop")) | F.contains(F.col("lop"), lo), "inner").select("op", "ord", "fkey")
    else:
        low = names.where("op IS NOT NULL").select("op", F.lower("op").alias("lo"))
        first = d.where("lop IS NOT NULL").groupBy("lop").agg(F.min_by(F.struct("ord", "fkey"), "ord").alias("e")).select("lop", "e.*")
        entries, texts = first.where("lop <> ''").select("lop"), low.where("lo <> ''").select("lo").distinct()
        met = (contained_pairs(entries.select(F.col("lop").alias("s")), texts.select(F.col("lo").alias("t"))).select(F.col("s").alias("lop"), F.col("t").alias("lo"))
               .unionAll(contained_pairs(texts.select(F.col("lo").alias("s")), entries.select(F.col("lop").alias("t"))).select(F.col("t").alias("lop"), F.col("s").alias("lo"))))
        pairs = met.join(first, "lop").join(low, "lo").select("op", "ord", "fkey")
        # an empty entry stands in every name, an empty name in every entry
        empty = first.where("lop = ''").select(F.struct("ord", "fkey").alias("e")).scalar()
        least = first.agg(F.min_by(F.struct("ord", "fkey"), "ord").alias("e")).scalar()
        always = low.select("op", F.when(F.col("lo") == "", least).otherwise(empty).alias("e")).where("e IS NOT NULL").select("op", "e.ord", "e.fkey")
        pairs = pairs.unionAll(always)
    hits = pairs.groupBy("op").agg(F.min_by("fkey", "ord").alias("fkey"))
    return (occ.join(hits, "op", "left")
            .withColumn("key", F.coalesce("key", "fkey")).drop("fkey"))


def attach_snippets(matches: DataFrame, snippets: DataFrame, require_available: bool = True,
                    small: bool = False) -> DataFrame:
    """Join matched keys to the snippet table; rows without a snippet are
    dropped when ``require_available`` (else kept with a null snippet)."""
    s = _dim(snippets.select("key", "snippet"), small)
    return matches.join(s, "key", "inner" if require_available else "left")


def reference_text_join(samples: DataFrame, dictionary: DataFrame, snippets: DataFrame, k: int = 3,
                        sep: str = "\n\n", require_available: bool = True,
                        id_col: str = "sample_id", ops_col: str = "ops", small: bool = False) -> DataFrame:
    """J4 in join form: (id, ref_keys, n_ref, ref_text) for samples with at least
    one matched snippet. Per-sample work after the dedupe is bounded by the
    number of distinct keys."""
    occ = explode_ops(samples, id_col, ops_col)
    m = match_fuzzy(match_exact(occ, dictionary, small), dictionary, small).where(F.col("key").isNotNull())
    if require_available:
        m = m.join(_dim(snippets.select("key"), small), "key", "left_semi")
    # one shuffle by sample carries keys only; texts join the at most k keys at the end
    agg = m.groupBy(id_col, "key").agg(F.min("pos").alias("pos")).groupBy(id_col).agg(
        F.slice(F.sort_array(F.collect_list(F.struct("pos", "key"))), 1, k).alias("s"))
    chosen = agg.select(id_col, F.posexplode("s").alias("at", "x")).select(id_col, "at", "x.key")
    text = attach_snippets(chosen, snippets, False, small)
    agg = text.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("at", "key", "snippet"))).alias("s"))
    return agg.select(id_col,
                      F.array_join(F.transform("s", lambda x: x["key"]), ",").alias("ref_keys"),
                      F.size("s").cast("long").alias("n_ref"),
                      F.array_join(F.transform("s", lambda x: F.coalesce(x["snippet"], F.lit(""))), sep)
                      .alias("ref_text"))


# ------------------------------------------------------------------ row-local form
def key_lookup(arch: str = "gfx1201", entries: list[tuple[str, str]] | None = None):
    """Return ``op -> key`` as a Column function built from a literal dictionary."""
    entries = entries if entries is not None else OP_DICTS[arch]
    exact = lit_map(entries)
    ordered = lit_struct_array([(op.lower(), key) for op, key in entries], ("m", "k"))

    def lookup(op: Column) -> Column:
        lo = F.lower(op)
        fuzzy = F.get(F.filter(ordered, lambda d: F.contains(lo, d["m"]) | F.contains(d["m"], lo)), 0)["k"]
        # coalesce evaluates the fuzzy scan only when the exact lookup misses
        return F.coalesce(F.try_element_at(exact, op), fuzzy)
    return lookup


def reference_text(samples: DataFrame, arch: str = "gfx1201", k: int = 3, sep: str | None = None,
                   require_available: bool | None = None, ops_col: str = "ops",
                   snippets: list[tuple[str, str]] | None = None) -> DataFrame:
    """Adds ``ref_keys`` (comma list), ``n_ref`` and ``ref_text``: the snippets of
    the first ``k`` distinct matched keys in op order, joined by ``sep``; '' when
    nothing matches. Row-local: no shuffle."""
    d_sep, d_req = ARCH_JOIN[arch]
    sep = d_sep if sep is None else sep
    require_available = d_req if require_available is None else require_available
    snips = snippet_rows(arch) if snippets is None else snippets
    snip_map = lit_map(snips)
    lookup = key_lookup(arch)
    keys = F.transform(F.coalesce(F.col(ops_col), F.array().cast("array<string>")), lookup)
    keep = F.filter(keys, (lambda x: x.isNotNull() & F.array_contains(F.map_keys(snip_map), x))
                    if require_available else (lambda x: x.isNotNull()))
    chosen = F.slice(F.array_distinct(keep), 1, k)
    return (samples.withColumn("_keys", chosen)
            .withColumn("ref_keys", F.array_join("_keys", ","))
            .withColumn("n_ref", F.size("_keys").cast("long"))
            .withColumn("ref_text", F.array_join(
                F.transform("_keys", lambda x: F.coalesce(F.try_element_at(snip_map, x), F.lit(""))), sep))
            .drop("_keys"))
