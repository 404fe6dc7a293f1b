"""Document fingerprints by consistent weighted sampling.

A document is its words, weighted by how often they occur. For each of K samples
every word draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from its own hash, and with

    t = floor(ln w / r + b),   ln a = ln c - r (t - b + 1)

the word of least ``a`` gives the sample (word, t). Two documents agree in a sample with
the probability of their generalised Jaccard similarity: the sum of the lesser over
the sum of the greater weights. The draws depend on the word alone, so a text and its
edited form share them. DataFrame functions only.

The texts are shuffled once, by ranges of doc_id; the next document, the word counts,
the samples and the next fingerprint are all found within a range. The first
document of a range stands in the range before as a guest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
#: Samples that one row of the sampling step takes: its compiled code stays small enough for the JVM's compiler.
WIDTH = 8
SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a uniform number, three of which come from a hash.
_BITS = 21
#: ln a counts in steps of 2^-20, in the upper half of a long; the lower half names the (word, t).
_STEP, _LOWER = 1 << 20, (1 << 32) - 1
_LEAST = -(1 << 63)


def _uniforms(seed: Column) -> list[Column]:
    """Three numbers in (0, 1) from a word's hash and a sample's number."""
    h = F.xxhash64("word", seed)
    mask = (1 << _BITS) - 1
    parts = [F.shiftrightunsigned(h, 64 - _BITS), F.shiftrightunsigned(h, 64 - 2 * _BITS).bitwiseAND(mask), F.shiftrightunsigned(h, 1).bitwiseAND(mask)]
    return [(x + F.lit(0.5)) * F.lit(2.0 ** -_BITS) for x in parts]


def draws() -> dict[str, Column]:
    """r, ln c and b of each sample of the row's ``group``: columns of their own, so both weights share them."""
    out = {}
    for i in range(WIDTH):
        number = F.col("group") * WIDTH + i
        u, v = _uniforms(2 * number), _uniforms(2 * number + 1)
        out |= {f"r{i}": -F.ln(u[0] * u[1]), f"c{i}": F.ln(-F.ln(v[0] * v[1])), f"b{i}": u[2]}
    return out


def least(weights: list[str]) -> list[Column]:
    """Per weight column and sample of the group its least (a, word, t); a weight of 0 has no logarithm and so none."""
    out = []
    for w in weights:
        for i in range(WIDTH):
            r, b = F.col(f"r{i}"), F.col(f"b{i}")
            t = F.floor(F.col(f"ln_{w}") / r + b)
            steps = F.floor((F.col(f"c{i}") - r * (t - b + 1)) * _STEP)
            key = F.shiftleft(steps, 32).bitwiseOR(F.col("word").bitwiseXOR(F.shiftleft(t, 3)).bitwiseAND(_LOWER))
            out.append(F.min(key).alias(f"{w}_{i}"))
    return out


def digest(groups: Column, weight: str, samples: int) -> Column:
    """Eight hex digits of each sample; zeros where there is no word."""
    def one(g):
        return F.concat(*[F.lpad(F.lower(F.hex(g[f"{weight}_{i}"].bitwiseAND(_LOWER))), 8, "0") for i in range(WIDTH)])

    found = F.filter(groups, lambda g: g[f"{weight}_0"].isNotNull())
    return F.when(F.size(found) > 0, F.concat_ws("", F.transform(F.array_sort(found), one))).otherwise(F.lit("0" * 8 * samples))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of samples in which two fingerprints agree."""
    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: a.substr(8 * i + 1, F.lit(8)) == b.substr(8 * i + 1, F.lit(8)))
    return F.size(same) / F.lit(float(samples))


def ranged(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text, bucket, guest): ``bucket`` is a range of doc_id; the first rows of
    each bucket stand once more, as guests, in the one before (the first bucket's in the last)."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] if buckets > 1 else None
    cuts = sorted(set(cuts or []))
    bucket = F.lit(0)
    if cuts:  # found in two steps: as many comparisons as twice the root of the buckets
        size = max(1, int(len(cuts) ** 0.5))
        parts = [cuts[i:i + size] for i in range(0, len(cuts), size)]
        key = F.col("doc_id")
        upper = F.size(F.filter(F.array(*[F.lit(p[0]) for p in parts]), lambda c: c <= key))
        within = F.element_at(F.array(*[F.array(*[F.lit(c) for c in p]) for p in parts]), F.greatest(upper, F.lit(1)))
        bucket = F.when(key.isNull() | (upper == 0), 0).otherwise((upper - 1) * size + F.size(F.filter(within, lambda c: c <= key)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bucket.cast("int").alias("home"))
    firsts = {r.home: r.first for r in rows.groupBy("home").agg(F.min(F.coalesce("doc_id", F.lit(_LEAST))).alias("first")).collect()}
    if not firsts:
        return rows.select("doc_id", "text", F.col("home").alias("bucket"), F.lit(0).alias("guest"))
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    places = range(max(used) + 1)
    at = F.col("home") + 1
    first = F.element_at(F.array(*[F.lit(firsts.get(b)).cast("bigint") for b in places]), at)
    previous = F.element_at(F.array(*[F.lit(before.get(b)).cast("int") for b in places]), at)
    here = F.struct(F.col("home").alias("bucket"), F.lit(0).alias("guest"))
    there = F.struct(previous.alias("bucket"), F.lit(1).alias("guest"))
    homes = F.when(F.coalesce("doc_id", F.lit(_LEAST)) == first, F.array(here, there)).otherwise(F.array(here))
    return rows.select("doc_id", "text", F.explode(homes).alias("at")).select("doc_id", "text", "at.bucket", "at.guest")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs``.

    A text's edited form has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document in the order of doc_id; after the last comes
    the first, so a single row is its own next one. Rows of one doc_id follow each other
    by the hash of their texts; null doc_id comes first. Null text is empty. Texts without words have a
    fingerprint of zeros: alike to each other, unlike all others. Repeated rows are all
    returned. An empty table gives an empty result. Other columns are not looked at.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = ranged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), 8 * partitions).withColumn("by", F.xxhash64("text"))
    in_order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "by")
    length, cut = F.length("text"), F.floor(F.length("text") / 4)
    edited = F.concat(F.col("text").substr(F.lit(1), (length - cut).cast("int")), F.coalesce(F.col("next").substr(F.lit(1), cut.cast("int")), F.lit("")))
    rows = (source.withColumns({"next": F.lead("text").over(in_order), "place": F.row_number().over(in_order)})
            .select("bucket", "place", "guest", "doc_id", "text", length.cast("bigint").alias("n_chars"), edited.alias("edited")))
    # One row for the text, one for the edited text, one for what else is known of the document.
    about = F.struct("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "guest")
    bodies = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body"), F.lit(None).cast("struct<doc_id:bigint,n_chars:bigint,edited_sha256:string,guest:int>").alias("about")),
                     F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"), F.lit(None).alias("about")),
                     F.struct(F.lit(2).alias("kind"), F.lit("").alias("body"), about.alias("about")))
    words = (rows.select("bucket", "place", F.inline(bodies)).select("bucket", "place", "kind", "about", F.explode(F.split("body", SPACE)).alias("text"))
             .filter("kind = 2 OR text != ''").select("bucket", "place", "kind", "about", F.xxhash64("text").alias("word")))
    # The exchange by bucket serves this and all that follows.
    counts = words.groupBy("bucket", "place", "about", "word").agg(F.count_if(F.col("kind") == 0).alias("w0"), F.count_if(F.col("kind") == 1).alias("w1"))
    counts = counts.select("bucket", "place", "about", "word", F.ln("w0").alias("ln_w0"), F.ln("w1").alias("ln_w1"))
    drawn = counts.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(samples // WIDTH - 1)))).withColumns(draws())
    groups = drawn.groupBy("bucket", "place", "about", "group").agg(*least(["w0", "w1"]))
    values = [f"{w}_{i}" for w in ("w0", "w1") for i in range(WIDTH)]
    done = groups.groupBy("bucket", "place").agg(F.max("about").alias("about"), F.collect_list(F.when(F.col("about").isNull(), F.struct("group", *values))).alias("all"))
    done = done.select("bucket", "place", "about.*", digest(F.col("all"), "w0", samples).alias("fingerprint"), digest(F.col("all"), "w1", samples).alias("edited_fingerprint"))
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    return (done.withColumn("next", following).filter("guest = 0")
            .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next"), samples).alias("near_next")))
