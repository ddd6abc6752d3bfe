"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set are its distinct word shingles, as 64-bit hashes. Equal sets are one class from the start. Two sets with
a Jaccard similarity of t share a token among their first n - ceil(t n) + 1 tokens under any order that is the same for
all documents, and at least l tokens among the first n - ceil(t n) + l. This is used twice:

1. Under the order of the hashes themselves, with l a part of n: a class of whose first tokens too few stand among the
   first tokens of any other class has no link and leaves. Most text ends here; only these first tokens are shuffled.
2. The classes that are left count the tokens of their whole sets. Under several orders from rare to frequent, with ties
   broken by different hashes, candidates come from the first order and must meet in the others too before the sets are
   compared in full.

Pairs are not expanded within large groups: a class is first compared with the most central class of each of its tokens,
then with another; after that only classes of different components still meet, all of them, so that no link that matters
is lost. Where classes meet, a bitmap of each set gives a lower bound of how many tokens two sets do not share, and pairs
that it shows to be apart are never made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.common import batches_of_texts, components, released, shingle_hashes, small_side, stored, stored_counting, text_or_empty, word_hashes

ORDERS = 3
STAR_ROUNDS = 2
#: Words of 64 bits in a set's bitmap: each token flips one bit, so two bitmaps differ in no more bits than the sets in tokens.
BITMAP = 4
BITS = [f"bits{i}" for i in range(BITMAP)]


def _sets(texts: pd.Series, k: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for at, end in batches_of_texts(texts.str.len().to_numpy(), 2 << 20):
        words, places, *_ = word_hashes(texts.iloc[at:end])
        for a, b in zip(places[:-1], places[1:]):
            yield np.unique(shingle_hashes(words[a:b], k).view(np.int64))


def _class_of(tokens: np.ndarray) -> int:
    """A 64-bit name of the set; sets that share it count as equal."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bitmap(tokens: np.ndarray) -> list[int]:
    odd = np.bincount((tokens.view(np.uint64) >> np.uint64(7)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _extra(n, share: float):
    """l: how many tokens must meet among the first ones under the order of hashes."""
    return np.maximum(1, np.floor(n * share)) if not isinstance(n, Column) else F.greatest(F.lit(1), F.floor(n * share))


def _least(n: Column, num: int, den: int) -> Column:
    """ceil(n * num / den) in whole numbers."""
    return F.call_function("div", n * num + (den - 1), F.lit(den))


def similar(both: Column, n_x: Column, n_y: Column, num: int, den: int) -> Column:
    return both * den >= (n_x + n_y - both) * num


def shingle_classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Per row: doc_id, n (size of the set), cid (class), head (its first tokens under the order of hashes)."""
    share = (den - num) / den

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, names, heads = [], [], []
            for tokens in _sets(batch["content"], k):
                n = len(tokens)
                first = n - (n * num + den - 1) // den + int(_extra(n, share)) if n else 0
                sizes.append(n)
                names.append(_class_of(tokens))
                heads.append(tokens[:first])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": sizes, "cid": names, "head": heads})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("content"))
    return rows.mapInPandas(run, "doc_id long, n long, cid long, head array<long>")


def _survivors(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Classes (cid) of whose first tokens enough stand among those of other classes."""
    share = (den - num) / den
    # One row stands for each class; the rows beside it are few unless copies are many, then they are joined by a shuffle.
    sets = classes.where("n > 0")
    place = F.struct("doc_id", "at")
    first = sets.groupBy("cid").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows"))
    extra = sets.join(first.where("rows > 1").select("cid", "first"), "cid").where(F.struct("doc_id", "at") != F.col("first"))
    extra, rows = stored_counting(extra.select(F.col("at").alias("beside")), "copies")
    heads = sets.join(small_side(extra, 16, rows), F.col("at") == F.col("beside"), "left_anti")
    # Both uses below read the same two columns, so the tokens are shuffled once; numbers of rows stand for the classes.
    tokens = heads.select("at", F.explode("head").alias("token")).repartition("token")
    shared = tokens.groupBy("token").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b").select("token")
    met = stored(tokens.join(shared, "token").groupBy(F.col("at").alias("of")).count(), "met")
    n = F.col("n")
    need = F.least(_extra(n, share), _extra(_least(n, num, den), share))
    left = stored(met.join(classes.select("at", "cid", "n"), F.col("of") == F.col("at")).where(F.col("count") >= need).select("cid"), "survivors")
    released(extra, met)
    return left


def _whole_sets(docs: DataFrame, classes: DataFrame, cids: DataFrame, k: int, unnamed: bool) -> DataFrame:
    """The whole sets of the classes, from one row of each: cid, n, tokens and the bitmap.

    A class with an identifier is read from the document of its smallest one. If rows without identifier have words
    (``unnamed``), those rows are read too and stand for the classes that have no other row.
    """
    held = classes.join(cids, "cid").groupBy("cid").agg(F.min("doc_id").alias("of"))
    wanted, named = stored_counting(held, "wanted", F.col("of").isNotNull())
    columns = f"cid long, n long, tokens array<long>, {', '.join(b + ' long' for b in BITS)}"

    def sets(batches: Iterator[pd.DataFrame], check: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            named = ((_class_of(t), t) for t in _sets(batch["content"], k))
            rows = [(c, len(t), t, *_bitmap(t)) for i, (c, t) in enumerate(named) if not check or c == batch["cid"].iloc[i]]
            yield pd.DataFrame(rows, columns=["cid", "n", "tokens", *BITS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("content"))
    joined = rows.join(small_side(wanted.where("of is not null"), 24, named), rows["doc_id"] == F.col("of")).select("cid", "content")
    out = joined.mapInPandas(lambda batches: sets(batches, True), columns)
    if unnamed:
        others = rows.where("doc_id is null").select("content").mapInPandas(lambda batches: sets(batches, False), columns)
        out = out.union(others.join(wanted.where("of is null").select("cid"), "cid", "left_semi"))
    return stored(out.dropDuplicates(["cid"]), "sets")


def _ordered(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Per class: cid, n, u (tokens of no other class), tokens (the others), p0, p1, ...: its first tokens by each order.

    Tokens of no other class come first in every order; a class with so many that none of the others is among its first
    tokens has no link.
    """
    tokens = sets.select("cid", F.explode("tokens").alias("token")).repartition("token")
    frequent = tokens.groupBy("token").agg(F.count("cid").alias("df")).where("df > 1")  # reads both columns, so that one shuffle serves both
    held = tokens.join(frequent, "token").groupBy("cid").agg(F.collect_list(F.struct("df", "token")).alias("held"))
    held = held.join(sets.select("cid", "n", *BITS), "cid")
    u = F.col("n") - F.size("held")
    first = (F.col("n") - _least(F.col("n"), num, den) + 1 - u).cast("int")

    def prefix(order: int) -> Column:
        rarity = (lambda t: F.floor(F.log2(t["df"]))) if order == ORDERS - 1 else (lambda t: t["df"])
        keyed = F.transform("held", lambda t: F.struct(rarity(t).cast("long").alias("rarity"), F.xxhash64(F.lit(order), t["token"]).alias("tie"), t["token"].alias("token")))
        return F.transform(F.slice(F.array_sort(keyed), F.lit(1), first), lambda t: t["token"])

    kept = held.where(first > 0)
    return stored(kept.select("cid", "n", u.alias("u"), *BITS, F.transform("held", lambda t: t["token"]).alias("tokens"), *[prefix(i).alias(f"p{i}") for i in range(ORDERS)]), "prefixes")


def _links(pairs: DataFrame, ordered: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (x, y) that meet under all other orders and are similar by their whole sets."""

    def side(name: str) -> DataFrame:
        others = [F.col(f"p{i}").alias(f"p{i}_{name}") for i in range(1, ORDERS)]
        return ordered.select(F.col("cid").alias(name), F.col("n").alias(f"n_{name}"), F.col("tokens").alias(f"t_{name}"), *others)

    met = pairs.join(side("x"), "x").join(side("y"), "y")
    for i in range(1, ORDERS):
        met = met.where(F.arrays_overlap(f"p{i}_x", f"p{i}_y"))
    both = F.size(F.array_intersect("t_x", "t_y")).cast("long")
    return met.where(similar(both, F.col("n_x"), F.col("n_y"), num, den)).select("x", "y")


def _class_components(ordered: DataFrame, num: int, den: int) -> DataFrame:
    """Classes with links to the smallest class they reach: node, root."""
    tokens = stored(ordered.select("cid", "n", "u", *BITS, F.explode("p0").alias("token")), "first-tokens")
    links = roots = None
    labelled = 0

    def possible(x: str, y: str) -> Column:
        """Whether two classes can be similar at all, given what no other class shares and how their bitmaps differ."""
        most = F.least(F.col(f"{x}.n") - F.col(f"{x}.u"), F.col(f"{y}.n") - F.col(f"{y}.u"))
        differ = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITS[1:]), F.bit_count(F.col(f"{x}.{BITS[0]}").bitwiseXOR(F.col(f"{y}.{BITS[0]}"))))
        near = differ * (den + num) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (den - num)
        return similar(most, F.col(f"{x}.n"), F.col(f"{y}.n"), num, den) & near

    for turn in range(STAR_ROUNDS + 1):
        if roots is None:
            placed = tokens.withColumn("comp", F.col("cid"))
        else:
            known = roots.withColumnRenamed("node", "cid")
            placed = tokens.join(small_side(known, 16, labelled), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")
        open_tokens = placed.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min(F.struct(F.col("u") if turn == 0 else F.lit(0), F.xxhash64(F.lit(turn), "cid"), "cid", "comp", "n", F.col("u").alias("own_u"), *BITS)).alias("lead"))
        open_tokens = open_tokens.where("a <> b").select("token", "lead")
        if turn < STAR_ROUNDS:
            x, y = placed.alias("x"), open_tokens.select("token", "lead.cid", "lead.comp", "lead.n", F.col("lead.own_u").alias("u"), *[f"lead.{b}" for b in BITS]).alias("y")
            apart = F.col("x.comp") != F.col("y.comp")
        else:
            left = placed.join(open_tokens.select("token"), "token", "left_semi")
            x, y = left.alias("x"), left.alias("y")
            apart = F.col("x.comp") < F.col("y.comp")
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & possible("x", "y")).select(F.col("x.cid").alias("x"), F.col("y.cid").alias("y")).distinct()
        new, found = stored_counting(_links(pairs, ordered, num, den), "links")
        if roots is None or found:
            links = new if links is None else links.union(new)
            roots = components(links)
            labelled = roots.count()
    released(tokens)
    return roots


def similar_components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    Documents link when their Jaccard similarity is at least num / den. Words are parted by white space and lower-cased in
    A-Z; with fewer than k words all of them make one shingle; without words the set is empty and links with nothing. Rows
    without an identifier have no component (null), but links run through their texts. Rows that repeat an identifier stand for their own texts. An empty
    table gives an empty result.
    """
    numbered = shingle_classes(docs, k, num, den).withColumn("at", F.monotonically_increasing_id())
    headed, unnamed = stored_counting(numbered, "heads", F.col("doc_id").isNull() & (F.col("n") > 0))
    left = _survivors(headed, num, den)
    classes = stored(headed.select("doc_id", "n", "cid"), "classes")
    released(headed)
    sets = _whole_sets(docs, classes, left, k, unnamed > 0)
    ordered = _ordered(sets, num, den)
    released(sets)
    roots = _class_components(ordered, num, den).withColumnRenamed("node", "cid")
    released(ordered)
    rows = classes.select("doc_id", "n", "cid").join(small_side(roots, 16), "cid", "left")
    rows = rows.select("doc_id", "n", F.coalesce("root", "cid").alias("of"))
    groups = rows.where("n > 0").groupBy(F.col("of").alias("root")).agg(F.min("doc_id").alias("first_id"))
    joined = rows.join(groups, (F.col("of") == F.col("root")) & (F.col("n") > 0), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("first_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents with the same columns, without those that a document with a smaller identifier represents.

    Documents without identifier or without words stay.
    """
    gone, rows = stored_counting(similar_components(docs, **settings).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "represented")
    return docs.join(small_side(gone, 8, rows), docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
