"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct 5-word shingles; two documents link when
the Jaccard similarity of their sets is 0.8 or more.  Result: the connected
components of all links, exactly.

Documents with the same set are one set (equal copies are never paired).
Similar sets are partitioned into groups, the matrix keeps each group's token
union, and a set opens another group only if its overlap with that union
reaches a bound.  Both sides need only the first tokens of each set in one
global order: if two sets of n and m tokens link, they share
``min(l(n), l(m))`` of their first ``n - ceil(0.8 n) + l(n)`` and
``m - ceil(0.8 m) + l(m)`` tokens, with ``l(n) = 1 + n // 10``; sizes differ by
a factor of 0.8 at most, so a set must share ``1 + 2n // 25``.  Any order is
right; frequent tokens are put last, so that a passage in many documents is
rarely among the first.

Steps:

1. One pass over the texts: size and fingerprint of each set; tokens met often
   within a block of documents (a lossy frequency count).  The HOT most frequent
   ones, a list of fixed size, are put last in the order.
2. All other documents are first taken as one group: a set whose first tokens
   overlap with all others' by less than the bound has no link and is done.
3. The sets that remain are partitioned into groups by min-hash rounds: in key
   order, sets with the most frequent tokens first, each is compared with up to
   LEADERS leaders of its key and joins the first it links with (an exact test);
   leaders go on to the next round.  Keys held by many sets are split.
4. Tokens in one group only cannot be part of a link between groups.  A set whose
   first tokens without them are below the bound is done, and then a set of which
   less than 0.8 is left without them; the tokens are looked at by halves, and a
   set that misses more than 0.2 of its size in the first sends no others.
5. The matrix (token, group) over the rest, groups taken apart by size class
   (sets of 2^(1/8) times the size at most).  Sets of the smaller group query
   the larger.  A link between sets of n and m tokens needs an overlap of
   4 (n + m) / 9, which bounds the overlap of first tokens for each class.  Of
   a set's t first tokens in other groups of the class, the t - bound + k in the
   fewest groups are looked up; a group that reaches the bound holds k of them
   (k = 1 + bound // 8).  For a group of CROWD sets or more the overlap is then
   looked for in the union of its whole sets.  Groups that qualify are opened
   and their members compared exactly.

Set fingerprints and tokens are 64-bit hashes; two of k different sets share a
fingerprint with a chance of about k^2 / 2^65.

Edge cases: fewer than five words are one shingle; null and wordless texts
have the empty set and link with nothing; a row without id links with nothing
and has a null component; repeated rows share their id's component; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakejoin.llm import shared, words
from lakejoin.llm.components import components

SHINGLE = 5
HOT = 1 << 16            # tokens put last in the order (512 KB)
BLOCK_TOKENS = 1 << 21   # tokens counted at a time
SEEN = 1 << 17           # fingerprints a task remembers, to emit equal sets once
OUT_TOKENS = 1 << 17     # tokens of an output batch (1 MB)
BLOCK_MIN = 4            # occurrences within a block that make a token a candidate for HOT
ROUNDS = 3
LEADERS = 32
KEY_ROWS = 2048          # sets of one key compared in one run
CROWD = 8                # sets of a group whose full token union is looked at before it is opened


def _sets(col: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for w in words.words(col, words.SPACED):
        g = words.grams(w.hashes, SHINGLE)
        bounds = w.bounds.tolist()
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s >= SHINGLE:
                t = np.sort(g[s:e - SHINGLE + 1])
                yield t[np.concatenate(([True], t[1:] != t[:-1]))]
            elif e > s:
                yield words.grams(w.hashes[s:e], e - s, salt=1)
            else:
                yield np.zeros(0, np.uint64)


def _fingerprint(t: np.ndarray) -> int:
    total = np.sum(words.mix(t ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return int(words.mix(np.array([total + np.uint64(len(t))], np.uint64)).view(np.int64)[0])


def bound(n: int) -> int:
    """Least overlap of a set of ``n`` tokens with a group that holds a link."""
    return 1 + (2 * n) // 25


def prefix_len(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 + n // 10


class _Order:
    """The global order: tokens outside the frequent list by hash, then the list
    from its least frequent token on."""

    def __init__(self, hot: np.ndarray):
        by = np.argsort(hot)
        self.hot, self.rank = hot[by], by

    def frequent(self, t: np.ndarray) -> int:
        """How many tokens of the set are in the list."""
        if not len(self.hot):
            return 0
        return int(np.count_nonzero(self.hot[np.minimum(np.searchsorted(self.hot, t), len(self.hot) - 1)] == t))

    def first(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens of a sorted set: those outside and inside the list."""
        p = prefix_len(len(t))
        if not len(self.hot):
            return t[:p], t[:0]
        i = np.minimum(np.searchsorted(self.hot, t), len(self.hot) - 1)
        is_hot = self.hot[i] == t
        cold = t[~is_hot][:p]
        if len(cold) == p:
            return cold, t[:0]
        rank = self.rank[i[is_hot]]
        return cold, t[is_hot][np.argsort(rank)][:p - len(cold)]


def _summary(docs: DataFrame) -> DataFrame:
    """kind 0: (id, q, n) of each document; kind 1: (token, count) of frequent tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size, seen = 0, set()

        def frequent():
            t, c = np.unique(np.concatenate(kept), return_counts=True)
            t, c = t[c >= BLOCK_MIN], c[c >= BLOCK_MIN]
            return out(np.ones(len(t)), t.view(np.int64), None, c)

        def out(kind, a, q, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), a if isinstance(a, pa.Array) else pa.array(a, pa.int64()),
                 pa.array(q, pa.int64()) if q is not None else pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64())],
                names=["kind", "a", "q", "n"])

        for batch in batches:
            qs, ns = [], []
            for t in _sets(batch.column("text")):
                q = _fingerprint(t) if len(t) else None
                qs.append(q)
                ns.append(len(t))
                if q is not None and q not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(q)
                    kept.append(t)
                    size += len(t)
                    if size >= BLOCK_TOKENS:
                        yield frequent()
                        kept.clear()
                        size = 0
            yield out(np.zeros(len(ns)), batch.column("id"), qs, ns)
        if kept:
            yield frequent()

    return shared.mapped(docs, run, "kind int, a bigint, q bigint, n bigint")


def _first_tokens(docs: DataFrame, hot) -> DataFrame:
    """(token, q, rest) of the first tokens outside the frequent list; ``rest``:
    what the bound asks for beyond the frequent ones.  A row without ``rest``, its
    token the fingerprint, stands for a set that needs no more.  Equal sets are
    emitted once a task."""
    def rows_of(toks: list[np.ndarray], qs: list[tuple[int, int | None, int]]) -> pa.RecordBatch:
        """``qs``: (q, rest, number of rows) of each piece of ``toks``."""
        n = [x[2] for x in qs]
        rest = np.repeat(np.array([x[1] or 0 for x in qs], np.int32), n)
        none = np.repeat(np.array([x[1] is None for x in qs]), n)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.repeat(np.array([x[0] for x in qs], np.int64), n)),
                                           pa.array(rest, mask=none)], names=["token", "q", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = _Order(hot.value), set()
        toks, qs, size = [], [], 0
        for batch in batches:
            for t in _sets(batch.column("text")):
                if not len(t):
                    continue
                q = _fingerprint(t)
                if q in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(q)
                cold, hots = order.first(t)
                rest = bound(len(t)) - len(hots)
                for part, r in ([(cold, rest)] if len(cold) else []) + ([(np.array([q]).view(np.uint64), None)] if rest <= 0 else []):
                    toks.append(part)
                    qs.append((q, r, len(part)))
                    size += len(part)
                if size >= OUT_TOKENS:
                    yield rows_of(toks, qs)
                    toks, qs, size = [], [], 0
        if qs:
            yield rows_of(toks, qs)

    return shared.mapped(docs, run, "token bigint, q bigint, rest int")


_KEYS = [f"k{r}" for r in range(ROUNDS)]


def _full_sets(docs: DataFrame, hot) -> DataFrame:
    """(id, q, n, toks, hots, min-hash keys) of each document; repeated rows are
    emitted once a task."""
    schema = "id bigint, q bigint, n int, cold int, toks array<bigint>, hots array<bigint>, " + ", ".join(f"{k} bigint" for k in _KEYS)
    names = ["id", "q", "n", "cold", "toks", "hots", *_KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = _Order(hot.value), set()
        for batch in batches:
            rows, size = [], 0

            def flush():
                cols = list(zip(*rows))
                got = pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()),
                     pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.list_(pa.int64())),
                     *[pa.array(c, pa.int64()) for c in cols[6:]]], names=names)
                rows.clear()
                return got

            for i, t in zip(batch.column("id").to_pylist(), _sets(batch.column("text"))):
                if not len(t):
                    continue
                q = _fingerprint(t)
                if (i, q) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add((i, q))
                _, hots = order.first(t)
                keys = [int(words.mix(t ^ np.uint64(0xA0761D6478BD642F * (r + 1) & ((1 << 64) - 1))).min().view(np.int64)) for r in range(ROUNDS)]
                rows.append((i, q, len(t), len(t) - order.frequent(t), t.view(np.int64), hots.view(np.int64), *keys))
                size += len(t)
                if size >= OUT_TOKENS:
                    yield flush()
                    size = 0
            if rows:
                yield flush()

    return shared.mapped(docs, run, schema)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets is 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    i = np.searchsorted(b, a)
    same = int(np.count_nonzero(b[np.minimum(i, len(b) - 1)] == a))
    return 5 * same >= 4 * (len(a) + len(b) - same)


def _round(sets: DataFrame, r: int) -> DataFrame:
    """One grouping round: sets with their ``parent`` (null for leaders and sets
    alone).  Rows of one set come out once; a set whose key no other row holds
    stays where it is."""
    key = _KEYS[r]
    held = shared.staged(sets.groupBy(key).agg(F.count("*").alias("held")).filter("held > 1"))
    sets, flag = shared.marked(sets, held, key)
    alone = sets.filter(~F.col(flag)).drop(flag).withColumn("parent", F.lit(None).cast("long"))
    sets = sets.filter(flag).drop(flag)
    crowded = held.filter(F.col("held") > KEY_ROWS)   # at most (number of rows) / KEY_ROWS rows
    keyed = sets.join(F.broadcast(crowded), key, "left").withColumn("part", F.when(
        F.col("held").isNull(), 0).otherwise(F.pmod(F.xxhash64("q"), F.ceil(F.col("held") / KEY_ROWS)))).drop("held")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = keyed.repartition(n, key, "part").sortWithinPartitions(key, "part", "cold", "q").select(*sets.columns, "part")

    names = sets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders, before = None, [], None
        for batch in batches:
            toks = batch.column("toks")
            off, flat = toks.offsets.to_numpy(), toks.values.to_numpy().view(np.uint64)
            parents, rows = [], []
            for i, (k, p, q) in enumerate(zip(batch.column(key).to_pylist(), batch.column("part").to_pylist(), batch.column("q").to_pylist())):
                if (k, p) != at:
                    at, leaders, before = (k, p), [], None
                if q == before:
                    continue
                before = q
                t = flat[off[i]:off[i + 1]]
                parent = next((lq for lq, lt in leaders if _linked(t, lt)), None)
                if parent is None and len(leaders) < LEADERS:
                    leaders.append((q, t.copy()))
                parents.append(parent)
                rows.append(i)
            batch = batch.take(pa.array(rows, pa.int64())) if len(rows) < batch.num_rows else batch
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(parents, pa.int64())], names=[*names, "parent"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.schema.fields)
    return shared.mapped(runs, run, f"{types}, parent bigint").unionByName(alone)


def _owned(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Add ``own``: the group of ``q`` by ``label`` (q, root), null for a set that is
    alone in its group.  Only rows of sets that may be in ``label`` are moved."""
    rows, flag = shared.marked(rows, label, "q")
    alone = rows.filter(~F.col(flag)).drop(flag).withColumn("own", F.lit(None).cast("long"))
    return rows.filter(flag).drop(flag).join(label.withColumnRenamed("root", "own"), "q", "left").unionByName(alone)


def _across(rows: DataFrame) -> DataFrame:
    """Rows whose token is in two groups or more; the group is ``own``, or the set
    itself.  A window over plain columns: one over the group would move it as well."""
    by_token = Window.partitionBy("token")
    found = {"lo": F.min("own"), "hi": F.max("own"), "lo_q": F.min("q"), "hi_q": F.max("q"), "grouped": F.count("own"), "n_rows": F.count("*")}
    return (rows.withColumns({k: v.over(by_token) for k, v in found.items()})
            .filter("if(grouped = 0, lo_q < hi_q, lo < hi or grouped < n_rows)").drop(*found))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id (smallest id of its component)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    summary = shared.staged(_summary(base))
    own = summary.filter("kind = 0").select(F.col("a").alias("id"), "q", "n")
    frequent = shared.staged(summary.filter("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("n").alias("n"))
                             .orderBy(F.desc("n"), "token").limit(HOT))             # at most HOT rows
    hot = sorted(frequent.collect(), key=lambda r: (-r["n"], r["token"]))
    frequent = F.broadcast(frequent.select("token"))
    hot_b = spark.sparkContext.broadcast(np.array([r["token"] for r in reversed(hot)], np.int64).view(np.uint64))
    reps = own.filter("id is not null and q is not null").groupBy("q").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    real = base.filter("id is not null")

    # 2. all other documents as one group
    by_token = Window.partitionBy("token")
    rows = _first_tokens(real, hot_b)
    shared_rows = shared.staged(
        rows.withColumns({"lo": F.min("q").over(by_token), "hi": F.max("q").over(by_token)})
        .filter("rest is null or lo < hi").select("token", "q", "rest").distinct()     # still by token: moved once
        .select(F.expr("if(rest is null, null, token)").alias("token"), "q", F.coalesce("rest", F.lit(0)).alias("rest")))
    active = (shared_rows.groupBy("q").agg(F.min("rest").alias("rest"), F.count("token").alias("got"))
              .filter("got >= rest").select("q").join(reps, "q"))
    active = shared.staged(active)
    sets = _full_sets(shared.maybe_in(real, active.select(F.col("rep").alias("id")), "id"), hot_b)
    # sets stay where they are: a few more rows pass the bitmaps, they link with nothing or are copies that the first round drops
    left = shared.staged(shared.maybe_in(sets, active, "q").drop("id"))
    hot_b.unpersist()

    # 3. groups; the first round leaves one row a set
    links = None
    for r in range(ROUNDS):
        done = shared.staged(_round(left, r).drop(_KEYS[r]))
        if r == 0:
            sets, done = done.select("q", "n", "toks", "hots"), done.drop("hots")
        new = done.filter("parent is not null").select(F.col("q").alias("a"), F.col("parent").alias("b"))
        links = new if links is None else links.unionByName(new)
        left = done.filter("parent is null").drop("parent")
    links = shared.staged(links)
    label = components(links).withColumnRenamed("node", "q")
    group = sets.select("q", "n").join(label, "q", "left") \
        .select("q", "n", F.coalesce("root", "q").alias("g"))
    group = shared.staged(group.join(group.groupBy("g").agg(F.count("*").alias("size")), "g").select("q", "n", "g", "size"))

    # 4. sets of which enough first tokens are in other groups, then sets that tokens of other groups cover
    # (a few more rows pass the bitmaps: they only make a token look shared, and meet ``group`` below)
    colds = shared.maybe_in(shared_rows.filter("token is not null").select("token", "q"), group, "q")
    colds = shared.staged(_across(_owned(colds, label)).select("token", "q"))
    hots = sets.select("q", F.explode("hots").alias("token")).join(group.select("q", "g"), "q")
    across = hots.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi").select("token")   # at most HOT rows
    hots = shared.staged(hots.join(F.broadcast(across), "token").select("token", "q"))
    first = colds.unionByName(hots)
    group = shared.staged(group.drop("size").join(first.groupBy("q").agg(F.count("*").alias("got")), "q")
                          .filter("got >= 1 + floor(2 * n / 25)").drop("got"))
    sets = shared.staged(_owned(shared.maybe_in(sets.select("q", "toks"), group, "q"), label))
    # half of the tokens at a time: a set that misses too many of the first half sends no others
    group = group.withColumn("missed", F.lit(0).cast("long"))
    for half in (0, 1):
        part = F.expr(f"filter(toks, t -> (t & 1) = {half})")
        every = sets.select("q", "own", F.explode(part).alias("token"))
        # frequent tokens are aggregated before they move and come back as a list of at most HOT rows
        often = every.join(frequent, "token")
        g = F.coalesce("own", "q")
        several = often.groupBy("token").agg(F.min(g).alias("lo"), F.max(g).alias("hi")).filter("lo < hi").select("token")
        rare = _across(every.join(frequent, "token", "left_anti"))
        covered = often.join(F.broadcast(several), "token").select("q").unionByName(rare.select("q")).groupBy("q").agg(F.count("*").alias("got"))
        group = group.join(sets.select("q", F.size(part).alias("asked")), "q").join(covered, "q", "left")
        group = shared.staged(group.select("q", "n", "g", (F.col("missed") + F.col("asked") - F.coalesce("got", F.lit(0))).alias("missed"))
                              .filter("5 * missed <= n"))
        sets = shared.maybe_in(sets, group, "q")
    group = group.drop("missed").withColumn("cls", F.floor(8 * F.log2("n")).cast("int"))
    group = shared.staged(group.join(group.groupBy("g").agg(F.count("*").alias("size")), "g").select("q", "n", "g", "size", "cls"))

    # 5. the matrix, and the groups that qualify
    sets = shared.staged(shared.maybe_in(sets.drop("own"), group, "q"))
    tokens = shared.staged(first.select("token", "q").join(group, "q"))
    matrix = tokens.select("token", "cls", F.col("g").alias("og"), F.col("size").alias("osize")).distinct()
    matrix = shared.staged(matrix)
    held = matrix.groupBy("token", "cls").agg(F.count("*").alias("groups"), F.min("og").alias("only"))
    # size range of each class: at most 8 rows for each doubling of the size
    classes = group.groupBy("cls").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    spare = lambda x: 1 + F.floor(x / 10) - F.ceil(4 * x / 5)
    at = lambda x: F.least(spare(F.col("n")), spare(x)) + F.ceil(4 * (F.col("n") + x) / 9)

    def sized(df: DataFrame, out: str) -> DataFrame:
        """Add the bound for sets of lo to hi tokens; it is least at the ends of
        the range that can link (2 for rounding)."""
        return (df.withColumns({"a": F.greatest("lo", F.ceil(4 * F.col("n") / 5)), "b": F.least("hi", F.floor(5 * F.col("n") / 4))})
                .filter("a <= b")
                .withColumn(out, F.greatest(1 + F.floor(2 * F.col("n") / 25), F.least(at(F.col("a")), at(F.col("b"))) - 2))
                .drop("lo", "hi", "b"))

    by_set = Window.partitionBy("q", "cls")
    asked = (tokens.withColumnRenamed("cls", "own").join(held, "token")
             .filter("abs(cls - own) <= 3 and (groups > 1 or only <> g)").drop("own", "only")
             .join(F.broadcast(classes), "cls"))
    asked = (sized(asked, "need").drop("a").withColumn("k", 1 + F.floor(F.col("need") / 8))
             .withColumns({"t": F.count("*").over(by_set), "nth": F.row_number().over(by_set.orderBy("groups", "token"))})
             .filter("t >= need and nth <= t - need + k").drop("groups", "t", "nth"))
    opened = (asked.join(matrix, ["token", "cls"])
              .filter("g <> og and (size < osize or (size = osize and g < og))")
              .groupBy("q", "n", "og", "osize", "cls", "need", "k").agg(F.count("*").alias("got")).filter("got >= k"))
    sizes = group.groupBy(F.col("g").alias("og"), "cls").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    opened = (sized(opened.join(sizes, ["og", "cls"]), "sharp").filter("got >= k + greatest(sharp - need, 0)")
              .select("q", "n", "a", "og", "osize", "cls"))
    opened = shared.staged(opened)
    crowded = opened.filter(F.col("osize") >= CROWD)
    members = group.select("q", F.col("g").alias("og"), "cls").join(crowded.select("og", "cls").distinct(), ["og", "cls"])
    union = members.join(sets.select("q", "toks"), "q").select("og", "cls", F.explode("toks").alias("token")).distinct()
    met = (crowded.join(sets.select("q", "toks"), "q").select("q", "n", "a", "og", "cls", F.explode("toks").alias("token"))
           .join(union, ["og", "cls", "token"]).groupBy("q", "n", "a", "og", "cls").agg(F.count("*").alias("got"))
           .filter("9 * got >= 4 * (n + a)").select("q", "n", "og", "cls"))
    opened = opened.filter(F.col("osize") < CROWD).select("q", "n", "og", "cls").unionByName(met)
    pairs = (opened.join(group.select(F.col("q").alias("x"), F.col("n").alias("nx"), F.col("g").alias("og"), "cls"), ["og", "cls"])
             .filter("5 * least(n, nx) >= 4 * greatest(n, nx)").select("q", "x"))
    pairs = shared.staged(pairs)
    met = (pairs.join(sets.select("q", "toks"), "q")
           .join(sets.select(F.col("q").alias("x"), F.col("toks").alias("xtoks")), "x")
           .select(F.col("q").alias("a"), F.col("x").alias("b"), F.size("toks").alias("n"), F.size("xtoks").alias("nx"),
                   F.size(F.array_intersect("toks", "xtoks")).alias("both"))
           .filter("5 * both >= 4 * (n + nx - both)").select("a", "b"))
    found = links.unionByName(shared.staged(met))

    root = components(found)
    named = reps.select("q", "rep").join(root.withColumnRenamed("node", "q"), "q", "left") \
        .select("q", "rep", F.coalesce("root", "q").alias("root"))
    named = shared.staged(named)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("q", "component_id")
    return (own.join(named, "q", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNull(), F.lit(None).cast("long"))
                    .otherwise(F.coalesce("component_id", "id")).alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked rows stays: the smallest id (null last),
    of equal ids the smallest row by a hash of all columns.  Rows are told apart
    by a key of their own, so repeated and null ids do not matter.  Rows with
    empty sets stay."""
    key, row_hash = shared.fresh(docs.columns, "row_no"), shared.fresh(docs.columns, "row_hash")
    rows = shared.staged(docs.withColumn(key, F.monotonically_increasing_id()))
    group = similar(rows, key, text_col).filter("n_shingles > 0").select(F.col(key), F.col("component_id").alias("component"))
    held = shared.staged(group.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component"))
    group = shared.staged(group.join(held, "component"))
    ids = shared.maybe_in(rows, group, key).select(
        F.col(key), F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.col(key)).alias(row_hash))
    kept = group.join(ids, key).groupBy("component").agg(F.min_by(key, row_hash).alias(key)).select(key)
    gone = shared.staged(group.select(key).join(kept, key, "left_anti"))
    return shared.without(rows, gone, key).select(*docs.columns)
