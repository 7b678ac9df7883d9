"""Document fingerprints by Order MinHash, in DataFrame functions alone.

A text is cut into words at white space; each run of k words is a k-mer, numbered by its occurrence in the text, and each
numbered k-mer has a hash. The hash names one of `tuples` bins and the order within it. Of each bin the `picked` least
numbered k-mers are taken, put back into text order and hashed together: that is one element of the signature. A bin that has
fewer borrows the least of the next bin that isn't empty (and so on, round), so that every element of a text of two k-mers or more
holds an order. This is one permutation with borrowing instead of a permutation for each element. Two texts that differ by a few edits share most numbered k-mers and their order, so they share elements; the same words in
another order share few. All of this happens inside the row, on sorted arrays of longs, without a shuffle.

A fingerprint lists, for each bin that isn't empty, the bin (two to five hex digits) and the element (eight). likeness() is
the share of equal elements among the bins that are not empty in both, 1 if there are none.

Cases: null counts as empty; an empty text, or one of white space, has the empty fingerprint; fewer than k words
are one k-mer; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TUPLES, PICKED, K = 32, 2, 3
_LOW = (1 << 31) - 1  # a packed long is 32 bits of hash, then 31 bits of place


def fingerprint(text: Column, tuples: int = TUPLES, picked: int = PICKED, k: int = K) -> Column:
    """Of a text column. Every step makes one array; a step that is used twice is bound once, by a lambda over one element."""
    if tuples & (tuples - 1) or not 1 < tuples <= 1 << 16:
        raise ValueError("tuples is a power of two from 2 to 65536")
    bin_shift = 63 - (tuples.bit_length() - 1)
    high = F.shiftrightunsigned
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def bound(value: Column, make) -> Column:
        return F.element_at(F.transform(F.array(value), make), 1)

    def kmers(w: Column) -> Column:
        """hash and place of each k-mer, sorted: equal k-mers stand together, by place."""
        n = F.greatest(F.size(w) - F.lit(k - 1), F.least(F.size(w), F.lit(1)))
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        hashed = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.sort_array(F.transform(at, lambda i: F.shiftleft(hashed(i), 31).bitwiseOR(i.cast("long"))))

    def numbered(s: Column) -> Column:
        """hash of each k-mer with its occurrence, and its place, sorted by the hash."""
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (high(F.get(s, i - 1), 31) != high(x, 31)), i)), lambda i: i.isNotNull())

        def runs(first: Column) -> Column:
            def run(a: Column, r: Column) -> Column:
                equal = F.slice(s, a + 1, F.coalesce(F.get(first, r + 1), F.size(s)) - a)
                return F.transform(equal, lambda x, o: F.xxhash64(high(x, 31), o).bitwiseAND(F.lit(0xFFFFFFFF << 31)).bitwiseOR(x.bitwiseAND(F.lit(_LOW))))

            return F.flatten(F.transform(first, run))

        return F.sort_array(bound(starts, runs))

    def taken(s: Column) -> Column:
        """The picked least of each bin."""
        return F.filter(s, lambda x, i: (i < picked) | (high(F.get(s, i - picked), bin_shift) != high(x, bin_shift)))

    def elements(t: Column) -> Column:
        def element(x: Column, i: Column) -> Column:
            own = F.slice(F.concat(t, F.slice(t, 1, picked)), i + 1, F.least(F.lit(picked), F.size(t)))  # from the next bins too, and round
            # Text order: the place goes to the front for the sort.
            order = F.sort_array(F.transform(own, lambda y: F.shiftleft(y.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(high(y, 31))))
            hashed = F.xxhash64(F.transform(order, lambda y: y.bitwiseAND(F.lit(0xFFFFFFFF))))
            digits = F.hex(F.shiftleft(high(x, bin_shift) + tuples, 32).bitwiseOR(hashed.bitwiseAND(F.lit(0xFFFFFFFF))))
            return F.when((i == 0) | (high(F.get(t, i - 1), bin_shift) != high(x, bin_shift)), F.lower(digits))

        return F.array_join(F.transform(t, element), ",")  # nulls are left out

    return bound(bound(bound(bound(words, kmers), numbered), taken), elements)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal elements of two fingerprints, of the bins that are not empty in both."""
    a, b = (F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ",")) for x in (a, b))
    bins = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda x: F.left(x, F.length(x) - 8))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def previous(ids: DataFrame) -> DataFrame:
    """ids (doc_id, n_chars, one row an id) to doc_id, previous_id, previous_chars; before the first comes the last.

    A range partitioning puts ids in order; lag is taken inside partitions, and the ends meet in a table of one row for
    each partition."""
    # A stated number of partitions, so that Spark doesn't join them at run time and both uses below see the same ones.
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy("doc_id")
    inside = ordered.withColumn("previous", F.lag(F.struct("doc_id", "n_chars")).over(w))
    row = Window.orderBy("part")  # as many rows as partitions
    ends = ordered.groupBy("part").agg(F.max(F.struct("doc_id", "n_chars")).alias("last"))
    ends = ends.select("part", F.coalesce(F.lag("last").over(row), F.max_by("last", "part").over(Window.partitionBy())).alias("before"))
    found = inside.join(ends, "part").select("doc_id", F.coalesce("previous", "before").alias("p"))
    return found.select("doc_id", F.col("p.doc_id").alias("previous_id"), F.col("p.n_chars").alias("previous_chars"))


def with_edits(documents: DataFrame, tuples: int = TUPLES, picked: int = PICKED, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter of its code points replaced by as many, or all,
    of the first of the next document (ascending doc_id, after the last: the first).

    doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next. Rows that share a doc_id are taken
    for copies of one document: each is returned, and if their texts differ the least fingerprint and start count. Rows with a
    null doc_id are returned with themselves as the next. A single document is its own next. An empty table gives no
    rows; other columns are not read.

    Numbers alone are put in order. Texts are shuffled once, by doc_id; each then sends the start that the one before it
    needs."""
    # Without an alias that changes nothing: Spark drops such an alias on one side of a join, and then shuffles twice.
    doc_id = F.col("doc_id") if documents.schema["doc_id"].dataType.simpleString() == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    docs = documents.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = docs.filter("doc_id is not null").repartition("doc_id")  # one shuffle, used wherever texts are asked for by id
    around = previous(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.char_length("text")).cast("long").alias("n_chars")))
    # Above the shuffle of texts, which both sides of the last join share, each fingerprint is made once. It goes to its own
    # document and, with the start of its text, to the one before.
    printed = named.join(around, "doc_id").withColumn("fingerprint", fingerprint(F.col("text"), tuples, picked, k))
    start = F.struct(F.expr("substring(text, 1, cast(previous_chars div 4 as int))").alias("head"), F.col("fingerprint").alias("of_next"))
    sent = printed.select(F.col("doc_id").alias("of"), F.col("previous_id"), start.alias("start"), "fingerprint")
    both = F.array(F.struct(F.col("previous_id").alias("id"), F.lit(True).alias("back")), F.struct(F.col("of").alias("id"), F.lit(False).alias("back")))
    sent = sent.withColumn("to", F.explode(both)).select(F.col("to.id").alias("doc_id"), F.when(F.col("to.back"), F.col("start")).alias("start"), F.when(~F.col("to.back"), F.col("fingerprint")).alias("fingerprint"))
    given = sent.groupBy("doc_id").agg(F.min("start").alias("start"), F.min("fingerprint").alias("fingerprint"))
    own = named.join(given, "doc_id").select("doc_id", "text", "fingerprint", "start.*")
    alone = docs.filter("doc_id is null").withColumn("fingerprint", fingerprint(F.col("text"), tuples, picked, k))
    alone = alone.select("doc_id", "text", "fingerprint", F.expr("substring(text, 1, cast(char_length(text) div 4 as int))").alias("head"), F.col("fingerprint").alias("of_next"))
    both = own.unionByName(alone).withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"), F.expr("substring(head, 1, cast(n_chars div 4 as int))")))
    both = both.withColumn("edited_fingerprint", fingerprint(F.col("edited"), tuples, picked, k))
    return both.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("of_next")).alias("near_next"))
