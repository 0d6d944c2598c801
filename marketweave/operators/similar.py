"""Similar titles over whole tables, without comparing all pairs of a scope.

Equal titles are one class, so any number of copies costs one comparison. Of two classes that must share k words, the rarest words of each, all but k - 1, hold a common one: classes
meet only on such words, and only where place and number of the words behind it still allow k. A word in a third of all titles is last in that order, so it makes no candidates by
itself. A title within another one holds the rarest run of GRAM characters of the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .stored import store

#: Characters from which on a title within another one counts as the same story.
GRAM = 12
#: Rows from which on a member is hot, and tasks that share a hot one while its frequency is looked up.
HOT, SALT = 10_000, 16
#: Classes of a scope, about, that a task holds on each of its two sides.
BLOCK = 16_384


def _with_frequency(each: DataFrame, keys: Sequence[str]) -> DataFrame:
    """each with often, the number of its rows with the same keys. Counts combine before they are shuffled; hot keys, few by nature, are looked up in each task and their rows spread over SALT tasks."""
    counts = each.groupBy(*keys).agg(F.count("*").alias("often"))
    hot = each.join(F.broadcast(counts.where(F.col("often") >= HOT).withColumnRenamed("often", "__hot")), list(keys), "left")
    salted = hot.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")))
    cold = counts.where(F.col("often") < HOT).withColumn("__salt", F.lit(0))
    return salted.join(cold, [*keys, "__salt"], "left").withColumn("often", F.coalesce("__hot", "often")).drop("__salt", "__hot")


def title_classes(docs: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """Members (scope, id, norm: the words in order) and classes (scope, id: the smallest one with that norm, norm, w: different words, size) of docs (scope, id, title), both stored.

    Titles without words that count are in neither. Rows that share scope and id each count.
    """
    norm = docs.select(F.col(scope).alias(scope), "id", t.title_tokens(F.col("title")).alias("tokens")).where(F.size("tokens") > 0).select(scope, "id", F.array_join("tokens", " ").alias("norm"))
    norm = store(norm, "titles")
    classes = norm.groupBy(scope, "norm").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    return norm, store(classes.select(scope, "id", "norm", F.array_distinct(F.split("norm", " ")).alias("w"), "size"), "title-classes")


def _met(sets: DataFrame, scope: str, least: Callable[[Column], Column]) -> DataFrame:
    """scope, a, b, u, v (members, rarest first), size_a, size_b of sets (scope, id, w; size where they have one) that meet on a rare member, a pair once: at the rarest member of both.

    Members travel with the sets that meet, so pairs are decided where they arise and none is shuffled.
    """
    size = F.col("size") if "size" in sets.columns else F.lit(1).cast("long")
    each = _with_frequency(sets.select(scope, "id", size.alias("size"), F.explode("w").alias("member")), [scope, "member"])
    ordered = each.groupBy(scope, "id").agg(F.array_sort(F.collect_list(F.struct("often", "member"))).alias("o"), F.first("size").alias("size"))
    ordered = ordered.select(scope, "id", "size", F.transform("o", lambda x: x["member"]).alias("w"), F.size("o").alias("n"))

    def front(k: Column, side: str, words: str) -> DataFrame:
        first = F.slice("w", F.lit(1), F.greatest(F.lit(0), (F.col("n") - k + 1).cast("int")))
        return ordered.select(F.col(scope).alias(f"__s_{side}"), F.col("id").alias(side), F.col("w").alias(words), F.col("n").alias(f"n_{side}"), F.col("size").alias(f"size_{side}"), F.posexplode(first).alias(f"pos_{side}", f"__m_{side}"))

    small, large = front(least(F.col("n")), "a", "u"), front(least(F.lit(1)), "b", "v")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    # At the first common member, none is before it: what is left behind it in both must be enough.
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= least(F.col("n_a"))
    met = small.join(large, (F.col("__s_a") == F.col("__s_b")) & (F.col("__m_a") == F.col("__m_b")) & smaller & room)
    return met.where(F.element_at(F.array_intersect("u", "v"), 1) == F.col("__m_a")).select(F.col("__s_a").alias(scope), "a", "b", "u", "v", "size_a", "size_b")


def candidates(sets: DataFrame, scope: str, least: Callable[[Column], Column]) -> DataFrame:
    """Pairs scope, a, b, among them all that sharing() keeps, of sets that meet on a rare member."""
    return _met(sets, scope, least).select(scope, "a", "b")


def sharing(sets: DataFrame, scope: str, least: Callable[[Column], Column]) -> DataFrame:
    """Pairs scope, a, b, overlap, n_a, n_b, size_a, size_b of sets (scope, id, w; size, else 1) of one scope that share least(n) members, where n is the number of members of the smaller one, a (of equal ones that with the smaller id).

    least must not fall as n grows. Sets that share nothing are never paired.
    """
    sized = _met(sets, scope, least).select(scope, "a", "b", F.size(F.array_intersect("u", "v")).alias("overlap"), F.size("u").alias("n_a"), F.size("v").alias("n_b"), "size_a", "size_b")
    return sized.where(F.col("overlap") >= least(F.col("n_a")))


def within(texts: DataFrame, scope: str, least: int = GRAM) -> DataFrame:
    """Pairs scope, a, b of texts (scope, id, norm; no two norms of a scope are equal) where a's text stands in b's and has least characters or more.

    Runs of characters are compared by hash, which only adds candidates. A text with a run of its own stands in no other, so only texts whose every run is shared look for others.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("norm") - least + 1), lambda i: F.xxhash64(F.substring("norm", i, F.lit(least)))))
    each = texts.where(F.length("norm") >= least).select(scope, "id", grams.alias("g")).select(scope, "id", F.size("g").alias("k"), F.explode("g").alias("gram"))
    shared = each.join(each.groupBy(scope, "gram").agg(F.count("*").alias("often")).where("often > 1"), [scope, "gram"])
    rarest = shared.groupBy(scope, "id").agg(F.min_by("gram", F.struct("often", "gram")).alias("gram"), F.count("*").alias("held"), F.max("k").alias("k")).where("held >= k")
    probes = rarest.select(F.col(scope).alias("__s"), F.col("gram").alias("__g"), F.col("id").alias("a"))
    met = probes.join(shared.select(scope, "gram", F.col("id").alias("b")), (F.col("__s") == F.col(scope)) & (F.col("__g") == F.col("gram")) & (F.col("a") != F.col("b"))).select(scope, "a", "b")
    left, right = texts.select(scope, F.col("id").alias("a"), F.col("norm").alias("x")), texts.select(scope, F.col("id").alias("b"), F.col("norm").alias("y"))
    return met.join(left, [scope, "a"]).join(right, [scope, "b"]).where(F.contains("y", "x")).select(scope, "a", "b")


def _same_story(n: Column) -> Column:
    """Fewest words that a title of n words may share with a larger one of the same story."""
    return F.least(F.greatest(F.lit(3), F.ceil(0.8 * n - 1e-9)), F.greatest(F.lit(4), F.ceil(0.67 * n - 1e-9)))


def _alike(o: Column, small: Column, large: Column) -> Column:
    """Whether titles of small and large words that have o in common tell the same story."""
    return ((o >= 3) & (o / small >= 0.8)) | ((o >= 4) & (o / large >= 0.67))


def similar_classes(classes: DataFrame, scope: str) -> DataFrame:
    """Pairs scope, a, b, size_a, size_b of classes whose titles tell the same story: enough common words of the smaller or of the larger, or one within the other. Each pair once."""
    kept = [scope, "a", "b", "size_a", "size_b"]
    words = sharing(classes, scope, _same_story).where(_alike(F.col("overlap"), F.least("n_a", "n_b"), F.greatest("n_a", "n_b"))).select(*kept)
    side = lambda x: classes.select(scope, F.col("id").alias(x), F.col("w").alias(f"w_{x}"), F.col("size").alias(f"size_{x}"))
    held = within(classes, scope).select(scope, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a"), [scope, "a"]).join(side("b"), [scope, "b"])
    n_a, n_b = F.size("w_a"), F.size("w_b")
    return words.unionByName(held.where(~_alike(F.size(F.array_intersect("w_a", "w_b")), F.least(n_a, n_b), F.greatest(n_a, n_b))).select(*kept))


def _shares(block: pa.Table, scope: str) -> pa.Table:
    """scope, class_id, beyond of two blocks of a scope (scope, id, w, size, own: the block that a row is of, i, j: the two): sums of size times weight over the classes of the other block (if both are one, over its other classes) that
    share two words and 0.34 of the smaller one, with the share as weight. Classes without any are absent.

    Common words with a whole block are counted at once, by the places of a class's words in it.
    """
    block = block.combine_chunks()
    i, j = block["i"][0].as_py(), block["j"][0].as_py()
    sets = block["w"].chunk(0)
    n = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
    word = sets.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    ids, size, own = block["id"].chunk(0).dictionary_encode().indices.to_numpy(), block["size"].to_numpy().astype(np.float64), block["own"].to_numpy()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    sums = np.zeros(block.num_rows)
    if len(right):
        row, at = np.repeat(np.arange(len(n)), n), np.full(len(n), -1)
        at[right] = np.arange(len(right))
        here = at[row] >= 0
        order = np.argsort(word[here], kind="stable")
        places = at[row[here]][order]
        ends = np.searchsorted(word[here][order], np.arange(word.max(initial=0) + 2)).tolist()
        # The fewest common words that link, by the words of the smaller set.
        few = np.array([next((o for o in range(2, k + 1) if o / k >= 0.34), k + 1) for k in range(n.max() + 1)])
        n_r, size_r, ids_r, gained = n[right], size[right], ids[right], np.zeros(len(right))
        enough = {k: few[np.minimum(k, n_r)] for k in np.unique(n[left]).tolist()}
        words, starts = word.tolist(), np.concatenate([[0], np.cumsum(n)]).tolist()
        for a in left.tolist():
            own_words = words[starts[a] : starts[a + 1]]
            common = np.bincount(np.concatenate([places[ends[x] : ends[x + 1]] for x in own_words]), minlength=len(right))
            hit = np.flatnonzero(common >= enough[len(own_words)])
            hit = hit[ids_r[hit] != ids[a]]
            weight = common[hit] / np.minimum(len(own_words), n_r[hit])
            sums[a] += weight @ size_r[hit]
            if i != j:
                gained[hit] += weight * size[a]
        sums[right] += gained
    found = np.flatnonzero(sums)
    return pa.table({scope: block[scope].take(pa.array(found)), "class_id": block["id"].take(pa.array(found)), "beyond": pa.array(sums[found])})


def class_degrees(classes: DataFrame, scope: str) -> DataFrame:
    """scope, class_id, beyond (weights of a class's edges to documents of other classes) of classes (scope, id, w, size) with edges; two that share two words and 0.34 of the smaller one have their share as weight. Rows of one id share its sum, and no edge.

    Each two blocks of a scope meet in one task, which returns a sum for each class. So no pair is a row, a task holds two blocks whatever the size of the scope, and a class moves once for each block of its scope. The comparisons themselves grow with the square of a scope.
    """
    blocks = classes.groupBy(scope).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = classes.select(scope, "id", "w", F.col("size").cast("long").alias("size")).join(blocks, scope).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = own.withColumn("other", other).select(scope, "id", "w", "size", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    spark = classes.sparkSession
    dealt = met.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), scope, "i", "j")
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    each = dealt.groupBy(scope, "i", "j").applyInArrow(lambda t: _shares(t, scope), f"`{scope}` {kinds[scope]}, class_id {kinds['id']}, beyond double")
    return each.groupBy(scope, "class_id").agg(F.sum("beyond").alias("beyond"))


def _beyond(pairs: DataFrame, scope: str, weight: Column) -> DataFrame:
    """scope, class_id, beyond: weight times the size of the other class, summed over the pairs (scope, a, b, size_a, size_b) of each class. Sums combine before they are shuffled."""
    end = lambda own, other: F.struct(F.col(own).alias("class_id"), (F.col(f"size_{other}") * weight).alias("w"))
    return pairs.select(scope, F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).groupBy(scope, F.col("e.class_id").alias("class_id")).agg(F.sum("e.w").alias("beyond"))


def title_links(docs: DataFrame, scope: str) -> DataFrame:
    """scope, id, class_id and links (other documents whose titles tell the same story, copies among them) of each document whose title has words that count."""
    members, classes = title_classes(docs, scope)
    linked = _beyond(similar_classes(classes, scope), scope, F.lit(1))
    counted = classes.select(scope, F.col("id").alias("class_id"), "norm", "size").join(linked, [scope, "class_id"], "left").select(scope, "norm", "class_id", (F.col("size") - 1 + F.coalesce("beyond", F.lit(0))).alias("links"))
    return members.join(counted, [scope, "norm"]).select(scope, "id", "class_id", "links")


def title_degrees(docs: DataFrame, scope: str) -> DataFrame:
    """scope, id, class_id and degree (weights of a document's edges in the whole title graph of its scope, where copies with two words or more have weight 1) of documents whose title has words that count."""
    members, classes = title_classes(docs, scope)
    copies = F.when(F.size("w") >= 2, F.col("size") - 1).otherwise(0)
    counted = classes.select(scope, F.col("id").alias("class_id"), "norm", copies.alias("copies")).join(class_degrees(classes, scope), [scope, "class_id"], "left").select(scope, "norm", "class_id", (F.col("copies") + F.coalesce("beyond", F.lit(0.0))).alias("degree"))
    return members.join(counted, [scope, "norm"]).select(scope, "id", "class_id", "degree")
