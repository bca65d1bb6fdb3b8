"""Jaccard self-join of documents on word shingles, by adaptive multi-match prefixes.

All tokens (shingles) stand in one global order: rare ones first. A document of n tokens whose partners must share
o = ceil(0.75 n) of them has as its prefix at match count m the first n - o + m tokens; two similar documents share at least
m tokens of their prefixes at m. Each document picks the m whose estimated cost (postings to scan, and candidates
to verify, from the document counts of its prefix tokens) is least; a pair is compared at the smaller m of the two.

1. One narrow row a document: its word-sequence class and the size of its set. Equal classes are one node.
2. Tokens, packed by hash range, meet their document counts; tokens of a single class go no further, which is exact, since no
   other set holds them: they come first in the order and only their number matters.
3. Classes with too few shared tokens to have a partner end here; the others store their shared tokens and post their prefix.
4. Links are found in rounds. In each of the first rounds every posting list proposes pairs of one pivot with the
   others, so a group of copies costs as many pairs as it has members; linked classes become one component. The last
   round proposes, in lists that still hold several components, every pair that crosses components (one side is always outside
   the list's largest component), unless the tokens they can still share are too few, by place in the order or by their sketches
   (parities of the shared tokens in SKETCH_BITS hash cells: each cell that differs is a token of one set alone). Proposed pairs with enough common prefix tokens are verified on their sets.
   Every link then lies within a component; none is lost.

Defined results: null and empty texts have an empty set, no links, and themselves as component; rows of equal
text, and repeated rows, are in one component; a null doc_id is ordered after all others; ties have no effect, as a
component is named by its smallest doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, map_texts, pick, release_memory, settled, sliced, small_batches
from .shingles import class_hashes, shingle_sets, words_of_texts

WIDTH = 5
#: Jaccard similarity of at least THRESHOLD / 100.
THRESHOLD = 75
#: Tokens of a hash range, about: what one task of step 2 holds at once.
RANGE_TOKENS = 3_000_000
#: Tokens that a task of step 2 gathers before it sends them on.
FLUSH_TOKENS = 1_500_000
#: Classes of a group of step 3, about.
GROUP_CLASSES = 4_000
#: Cost of verifying a candidate, in scanned postings.
VERIFY_COST = 50.0
MAX_MATCHES = 64
#: Postings of a list that one task works off together, about; longer lists are cut into blocks by class.
LIST_BLOCK = 256
PIVOT_ROUNDS = 3
#: Cells of a sketch, a multiple of 64. More cells decide longer sets; too few only let more pairs through to be verified.
SKETCH_BITS = 256


def _i64(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64)


def document_classes(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, class (hash of the word sequence), n_shingles."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, off = words_of_texts(batch["text"])
        text, _ = shingle_sets(words, off, width)
        n = np.bincount(text, minlength=len(off) - 1)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(_i64(class_hashes(words, off))), pa.array(n.astype(np.int64))], ["doc_id", "class", "n_shingles"])

    return map_texts(df, fn, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, class long, n_shingles long")


_PACKED = "range int, classes binary, counts binary, tokens binary"


def _end_to_end(table: pa.Table, column: str, kind) -> np.ndarray:
    """The values of a binary column, one row after another, as numbers; without a copy of each row."""
    parts = []
    for chunk in table[column].chunks:
        if len(chunk):
            off = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)
            a, b = int(off[chunk.offset]), int(off[chunk.offset + len(chunk)])
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[a:b] if b > a else np.zeros(0, np.uint8))
    return (np.concatenate(parts) if len(parts) != 1 else parts[0].copy()).view(kind) if parts else np.zeros(0, kind)


def _packed_tokens(df: DataFrame, ranges: int, width: int) -> DataFrame:
    """Tokens by hash range: the classes with tokens there and their token counts, then the tokens."""

    def run(batches):
        return settled(gathered(batches))

    def gathered(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            for part in sliced(batch):
                words, off = words_of_texts(part["text"])
                text, token = shingle_sets(words, off, width)
                cls = class_hashes(words, off)
                n = np.bincount(text, minlength=len(cls))
                fresh = np.fromiter((n[i] > 0 and not (c in seen or seen.add(c)) for i, c in enumerate(cls.tolist())), bool, len(cls))
                keep = fresh[text]
                text, token = text[keep], token[keep]
                held.append((cls[text], token))
                size += len(token)
                if size >= FLUSH_TOKENS:
                    got, held, size = held, [], 0
                    yield from flush(got)
        yield from flush(held)

    def flush(held):
        if not held:
            return
        cls, token = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        # the range is the high part of the token times the number of ranges, so ranges may be any number
        where = ((token >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(where, kind="stable")
        where, cls, token = where[order], cls[order], token[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]]) if len(where) else np.zeros(1, int)
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            head = np.concatenate([[0], np.flatnonzero(np.diff(cls[a:b])) + 1])
            counts = np.diff(np.concatenate([head, [b - a]])).astype(np.uint32)
            rows.append((int(where[a]), cls[a:b][head].tobytes(), counts.tobytes(), token[a:b].tobytes()))
            if len(rows) == 64:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def _rows(rows):
        kinds = [pa.int32(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["range", "classes", "counts", "tokens"])

    return df.mapInArrow(run, _PACKED)


_SHARED = "grp int, classes binary, counts binary, keys binary, df binary"


def _shared_tokens(packed: DataFrame, groups: int) -> DataFrame:
    """Tokens of two classes or more with their class counts, packed by group of classes."""

    def fn(key, table):
        cls = np.repeat(_end_to_end(table, "classes", np.uint64), _end_to_end(table, "counts", np.uint32))
        tok = _end_to_end(table, "tokens", np.uint64)
        release_memory()
        order = np.argsort(tok)
        cls, tok = cls[order], tok[order]
        order = None
        # only tokens that stand there twice can be of two classes
        same = tok[1:] == tok[:-1]
        some = np.zeros(len(tok), bool)
        some[1:] |= same
        some[:-1] |= same
        cls, tok = cls[some], tok[some]
        order = np.lexsort((cls, tok))
        cls, tok = cls[order], tok[order]
        fresh = np.ones(len(tok), bool)  # the same class from another task
        fresh[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])
        cls, tok = cls[fresh], tok[fresh]
        head = np.concatenate([[0], np.flatnonzero(np.diff(tok)) + 1, [len(tok)]]) if len(tok) else np.zeros(1, int)
        df = np.repeat(np.diff(head), np.diff(head)).astype(np.uint32)
        some = df > 1
        cls, full, df = cls[some], tok[some], df[some]
        grp = (cls >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
        order = np.lexsort((cls, grp))
        cls, full, df, grp = cls[order], full[order], df[order], grp[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(grp)) + 1, [len(grp)]]) if len(grp) else np.zeros(1, int)
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            head = np.concatenate([[0], np.flatnonzero(np.diff(cls[a:b])) + 1])
            rows.append((int(grp[a]), cls[a:b][head].tobytes(), np.diff(np.concatenate([head, [b - a]])).astype(np.uint32).tobytes(), full[a:b].tobytes(), df[a:b].tobytes()))
        kinds = [pa.int32(), *[pa.binary()] * 4]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["grp", "classes", "counts", "keys", "df"])

    return packed.groupBy("range").applyInArrow(fn, _SHARED)


def match_count(df: np.ndarray, unique: int, n: int, o: int) -> int:
    """The cheapest match count m. df: document counts of the shared tokens in the global order."""
    most = min(o, MAX_MATCHES)
    at = np.minimum(n - o + np.arange(1, most + 1) - unique, len(df))  # shared tokens in the prefix at m
    scan = np.concatenate([[0], np.cumsum(df - 1.0)])[np.maximum(at, 0)]
    return int(np.argmin(scan * (1 + VERIFY_COST / np.arange(1, most + 1)))) + 1


_NODES = "class long, n int, m int, keys array<bigint>, blocks array<int>, unique int, sketch array<bigint>"


def sketch(tok: np.ndarray) -> np.ndarray:
    """The parity of the number of tokens in each cell: two sets differ in at least as many tokens as their sketches in bits."""
    cells = np.bincount((tok >> np.uint64(16)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def _nodes(shared: DataFrame, sizes: DataFrame, groups: int, threshold: int) -> DataFrame:
    """Of each class that may have a partner: set size, match count, shared tokens in the global order, blocks of the lists of those posted, sketch. sizes: class, n."""

    def fn(key, table, known):
        cls = np.repeat(_end_to_end(table, "classes", np.uint64), _end_to_end(table, "counts", np.uint32))
        tok, df = _end_to_end(table, "keys", np.uint64), _end_to_end(table, "df", np.uint32)
        release_memory()
        size_of = dict(zip(known["class"].to_pylist(), known["n"].to_pylist(), strict=True))
        order = np.lexsort((tok, df, cls))
        cls, tok, df = _i64(cls[order]), tok[order], df[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cls)) + 1, [len(cls)]]) if len(cls) else np.zeros(1, int)
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            size = size_of[int(cls[a])]
            unique = size - int(b - a)
            o = -(-threshold * size // 100)
            if b - a >= o:
                m = match_count(df[a:b], unique, size, o)
                blocks = (df[a : a + max(0, size - o + m - unique)] // LIST_BLOCK + 1).astype(np.int32)
                rows.append((int(cls[a]), size, m, _i64(tok[a:b]), blocks, unique, sketch(tok[a:b])))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64())]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["class", "n", "m", "keys", "blocks", "unique", "sketch"])

    # the group as _shared_tokens counts it: the high half of the class, unsigned, times the number of groups
    known = sizes.select(F.shiftright(F.shiftrightunsigned("class", 32) * F.lit(groups), 32).cast("int").alias("grp"), "class", "n")
    return shared.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(fn, _NODES)


def connected(tables: Tables, labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (class, comp) with the components that links (a, b) join made one: each comp becomes the least of them.

    Components are contracted: every round each root takes the least root among itself and its neighbours, then
    labels follow their roots, until no link crosses. The rounds grow with the logarithm of a component's length.
    """
    roots = lambda: labels.select(F.col("class").alias("k"), F.col("comp").alias("c"))
    a, b = roots(), roots()
    edges = links.join(a, links.a == a.k).select("b", F.col("c").alias("ca")).join(b, F.col("b") == b.k).select("ca", F.col("c").alias("cb"))
    edges = tables.keep(edges.where("ca <> cb").distinct(), "edges")
    if edges.isEmpty():
        return labels
    parents = None  # root -> root, of all roots that edges name
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        step = tables.keep(both.groupBy("ca").agg(F.least("ca", F.min("cb")).alias("p")), "step")
        for _ in range(2):  # a parent's parent
            up = step.select(F.col("ca").alias("k"), F.col("p").alias("pp"))
            step = step.join(up, step.p == up.k, "left").select("ca", F.least("p", F.coalesce("pp", "p")).alias("p"))
        step = tables.keep(step, "step")
        if parents is None:
            parents = step
        else:
            up = step.select(F.col("ca").alias("k"), F.col("p").alias("pp"))
            parents = tables.keep(parents.join(up, parents.p == up.k, "left").select("ca", F.coalesce("pp", "p").alias("p")), "parents")
        x = step.select(F.col("ca").alias("k"), F.col("p").alias("px"))
        y = step.select(F.col("ca").alias("k"), F.col("p").alias("py"))
        moved = edges.join(x, edges.ca == x.k).select("cb", "px").join(y, F.col("cb") == y.k).select(F.col("px").alias("ca"), F.col("py").alias("cb"))
        edges = tables.keep(moved.where("ca <> cb").distinct(), "edges")
    up = parents.select(F.col("ca").alias("k"), F.col("p").alias("pp"))
    return tables.keep(labels.join(up, labels.comp == up.k, "left").select("class", F.coalesce("pp", "comp").alias("comp")), "labels")


def _fits(threshold: int):
    """For postings x, y of one token: the token counts for the pair's match count, and the sets can still share enough.

    A pair of match count m is found by its first m common tokens; at each of them it has at most m - 1 (and no more than stand there)
    before, and what follows in the shorter rest. Later common tokens need not propose the pair again.
    """
    x, y = F.col("x"), F.col("y")
    m = F.least(x["m"], y["m"])
    most = F.least(x["i"], y["i"], m - 1) + F.least(x["s"] - x["i"], y["s"] - y["i"])
    return (F.greatest(x["l"], y["l"]) <= m) & ((100 + threshold) * most >= threshold * (x["n"] + y["n"]))


def _alike(threshold: int):
    """For postings x, y with sketches sx, sy: sets that differ in so many tokens can still be similar enough."""
    x, y = F.col("x"), F.col("y")
    differ = sum(F.bit_count(F.col("sx")[i].bitwiseXOR(F.col("sy")[i])) for i in range(SKETCH_BITS // 64))
    return (100 + threshold) * (x["s"] + y["s"] - differ) >= 2 * threshold * (x["n"] + y["n"])


def _candidates(pairs: DataFrame, threshold: int) -> DataFrame:
    """Of x and y for each common posting: the pairs with enough of them."""
    x, y = F.col("x"), F.col("y")
    first = x["class"] < y["class"]
    lower, upper = F.when(first, x).otherwise(y), F.when(first, y).otherwise(x)
    ordered = pairs.where(_fits(threshold)).select(lower.alias("x"), upper.alias("y"))
    flat = ordered.select(x["class"].alias("a"), y["class"].alias("b"), x["n"].alias("na"), y["n"].alias("nb"), F.least(x["m"], y["m"]).alias("m"))
    return flat.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("m").alias("m"), F.count("*").alias("hits")).where("hits >= m").drop("hits", "m")


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """pairs (a, b, na, nb) and whether each is a link, from the shared tokens of both sets."""
    x = nodes.select(F.col("class").alias("kx"), F.col("keys").alias("x"))
    y = nodes.select(F.col("class").alias("ky"), F.col("keys").alias("y"))
    both = pairs.join(x, pairs.a == x.kx).join(y, pairs.b == y.ky)
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (100 * common >= threshold * (F.col("na") + F.col("nb") - common)).alias("linked"))


def components(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, rounds: int = PIVOT_ROUNDS, tables: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text): (doc_id, class, n_shingles) of each row, and (class, comp) of each class that may have a link."""
    tables = tables or Tables(docs.sparkSession)
    small_batches(docs.sparkSession)
    members = tables.keep(document_classes(docs, width), "members")
    sizes = members.where("n_shingles > 0").groupBy("class").agg(F.max("n_shingles").alias("n"))
    totals = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ranges, groups = int(totals[0] // RANGE_TOKENS) + 12, int(totals[1] // GROUP_CLASSES) + 12
    # a partition for each range, so that a task's share doesn't grow with the input
    packed = _packed_tokens(docs, ranges, width).repartitionById(ranges, F.col("range"))
    shared = tables.keep(_shared_tokens(packed, groups), "shared")
    tables.release()
    nodes = tables.keep(_nodes(shared, sizes, groups, threshold), "nodes")
    tables.release()
    tables.drop(shared)
    first = F.transform(F.slice("keys", F.lit(1), F.size("blocks")), lambda key, i: F.struct(key.alias("key"), F.get("blocks", i).alias("blocks")))
    posted = nodes.select("class", "n", "m", "unique", F.size("keys").alias("s"), F.posexplode(first).alias("i", "at")).withColumns({"key": F.col("at.key"), "blocks": F.col("at.blocks")})
    # the match count from which a token is in the prefix
    level = F.greatest(F.lit(1), F.col("unique") + F.col("i") - (F.col("n") - F.expr(f"cast(ceil({threshold} * n / 100) as int)")) + 1)
    me = F.struct("class", "n", "s", "i", level.cast("int").alias("l"), "m").alias("me")
    posts = tables.keep(posted.select("key", "blocks", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"), "class", "unique", me), "posts")
    # what is known of a list goes to each of its blocks
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    labels = tables.keep(nodes.select("class", F.col("class").alias("comp")), "labels")
    done = None
    for k in range(rounds + 1):
        if k:
            comp = labels.select(F.col("class").alias("k"), "comp")
            p = posts.join(comp, posts["class"] == comp.k).drop("k")
        else:
            p = posts.withColumn("comp", F.col("class"))
        # a posting that is too late in its set, even for the smallest set in the list, proposes no pair there
        least = p.groupBy("key").agg(F.min("me.n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("blocks").alias("blocks")).where("lo < hi").select(F.col("key").alias("lk"), each.alias("lb"), "least")
        p = p.join(least, (p.key == least.lk) & (p.block == least.lb)).where((100 + threshold) * (F.col("me.s") - F.col("me.i") + F.col("me.m") - 1) >= threshold * (F.col("me.n") + F.col("least"))).drop("lk", "lb", "least")
        # components only grow, so a list that is within one of them now, and a posting too late now, will never propose again
        p, spent = tables.keep(p, "live"), posts
        tables.release()
        tables.drop(spent)
        posts = p.drop("comp")
        if k < rounds:
            # the first pivot is the set with the smallest share of tokens of its own, which is nearest to all; later ones are random
            by = F.struct(F.when(F.lit(k == 0), F.col("unique") / F.col("me.n")), F.xxhash64("class", F.lit(k)))
            lists = p.groupBy("key").agg(F.min_by(F.struct("me", "comp"), by).alias("v"), F.max("blocks").alias("blocks")).select(F.col("key").alias("vk"), each.alias("vb"), "v")
            pairs = p.join(lists, (p.key == lists.vk) & (p.block == lists.vb)).where("comp <> v.comp").select(F.col("me").alias("x"), F.col("v.me").alias("y"))
        else:
            by = p.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max("blocks").alias("blocks"))
            main = by.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.max("blocks").alias("blocks")).where("comps > 1").select(F.col("key").alias("mk"), each.alias("mb"), "main")
            p = p.join(main, (p.key == main.mk) & (p.block == main.mb)).drop("mk", "mb")
            bits = nodes.select(F.col("class").alias("k"), "sketch")
            p = p.join(bits, p["class"] == bits.k)
            # the smaller side meets every block of the other
            out = p.where("comp <> main").select("key", each.alias("xb"), F.col("me").alias("x"), F.col("comp").alias("cx"), F.col("sketch").alias("sx"))
            rest = p.select(F.col("key").alias("k2"), "block", F.col("me").alias("y"), F.col("comp").alias("cy"), "main", F.col("sketch").alias("sy"))
            pairs = out.join(rest, (out.key == rest.k2) & (out.xb == rest.block) & (out.cx != rest.cy) & ((rest.cy == rest.main) | (out.x["class"] < rest.y["class"])) & _fits(threshold) & _alike(threshold))
            pairs = pairs.select("x", "y")
        fresh = _candidates(pairs, threshold)
        if done is not None:
            fresh = fresh.join(done, ["a", "b"], "left_anti")
        fresh = tables.keep(fresh, "pairs")
        tables.release()
        if fresh.isEmpty():
            continue
        checked = tables.keep(_verified(fresh, nodes, threshold), "checked")
        tables.release()
        labels = connected(tables, labels, checked.where("linked").select("a", "b"))
        seen = checked.select("a", "b")
        done = seen if done is None else done.union(seen)
    return members, labels


def join_components(df: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, class, n_shingles, component_id."""
    members, labels = components(pick(df, doc_id=id_col, text=text_col), width, threshold)
    return named(members, labels)


def named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with component_id, the least doc_id of the component; classes without labels are their own."""
    first = members.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("lowest"))
    per = first.join(labels.withColumnRenamed("class", "k"), F.col("class") == F.col("k"), "left").select("class", F.coalesce("comp", "class").alias("comp"), "lowest")
    least = per.groupBy("comp").agg(F.min("lowest").alias("component_id"))
    names = per.join(least, "comp").select(F.col("class").alias("k"), "component_id")
    out = members.join(names, (F.col("class") == F.col("k")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "class", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """docs without all but one document of each component (that of the smallest doc_id, then class; null ids last), with all columns; documents without words stay."""
    tables, names = Tables(docs.sparkSession), docs.columns
    members, labels = components(pick(docs, doc_id="doc_id", text="text"), width, threshold, tables=tables)
    one = lambda doc, cls: F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("null")), cls.cast("string"))
    # by component, not by its name: a doc_id may be null or stand in several components
    first = members.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("lowest"))
    per = first.join(labels.withColumnRenamed("class", "k"), F.col("class") == F.col("k"), "left").select(F.coalesce("comp", "class").alias("comp"), F.struct(F.col("lowest").isNull().alias("nameless"), "lowest", "class").alias("best"))
    kept = tables.keep(per.groupBy("comp").agg(F.min("best").alias("best")).select(one(F.col("best.lowest"), F.col("best.class")).alias("kept_key")), "kept")
    tables.only(kept)
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text, doc = names.index("text"), names.index("doc_id")

    def with_class(part: pa.RecordBatch) -> pa.RecordBatch:
        words, off = words_of_texts(part.column(text))
        cls = pa.array(_i64(class_hashes(words, off)), mask=np.diff(off) == 0)
        return pa.RecordBatch.from_arrays([*part.columns, cls], [*part.schema.names, "word_class"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
    classed = map_texts(flat, with_class, f"{kinds}, word_class long", f"c{text}").withColumn("key", one(F.col(f"c{doc}"), F.col("word_class")))
    wordless = classed.where("word_class is null").select(*flat.columns)
    found = classed.where("word_class is not null").join(kept, F.col("key") == F.col("kept_key"), "left_semi")
    # of rows that repeat both id and words one stays, the same in every run: that of the least hash of all its columns
    order = F.xxhash64(*(F.col(f.name) for f in flat.schema if "map<" not in f.dataType.simpleString()))
    alone = found.withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy(order))).where("rn = 1").select(*flat.columns)
    return alone.union(wordless).toDF(*names)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT r, g FROM (
  SELECT r, words AS g FROM w WHERE len(words) BETWEEN 1 AND 4
  UNION ALL SELECT r, list_slice(words, i, i + 4) FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 4))),
h AS (SELECT r, dense_rank() OVER (ORDER BY g) AS t FROM s),
n AS (SELECT r, count(*) AS n FROM h GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM h x JOIN h y ON x.t = y.t AND x.r < y.r GROUP BY x.r, y.r),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS r, a AS x FROM (SELECT DISTINCT a FROM e) UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.x),
m AS (SELECT reach.r, min(w.doc_id) AS c FROM reach JOIN w ON w.r = reach.x GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM w LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
