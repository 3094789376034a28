"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

The lexicon is learned: words and word beginnings that labelled toxic documents use far more often than others. A text
then gives a few rates: lexicon densities, hits near a second-person word, hits hidden by look-alike characters,
capitals, punctuation and so on. Trees are fitted on them and their output is calibrated on rows that the trees did not see.

Labels are used only of rows whose crc32(doc_id) mod 4 is not 2, at most ``SAMPLE`` of them (chosen by a hash of the id).
Training features of a row come from a lexicon that was made without the row's fold. Texts are scored whole; the
features need one pass and no shuffle. Labels, lang, source and doc_id are no features.

Defined results. Null or empty text: all features 0, scored like any other. Null doc_id: scored, not held out, never used
for training. Repeated rows get equal scores; repeated labels count as the largest. Without labelled rows of both classes, in
one fold and outside it, the score is the share of toxic labels (0 without any). An empty table gives an empty result. Other columns are kept apart
and not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from bedwise.llm.common import LOWER, byte_chunks, cut, prefix_hash, span_hash, word_spans, word_table

SAMPLE = 20_000
FOLDS = 3
LEXICON = 4_000
LEAST_DOCS, LEAST_ODDS = 3, 2.5
TREES, DEPTH = 20, 3
THRESHOLD = 0.3
PREFIX, NEAR = 4, 5
SECOND_PERSON = "you your yours yourself u ur tu te toi vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus".split()

FEATURES = [
    "length", "word_hits", "word_density", "word_kinds", "prefix_hits", "prefix_density", "hits_near_you", "you_density", "hidden_hits", "mixed_words",
    "capitals", "capital_words", "exclamations", "questions", "symbols", "single_letters", "repeated_letters", "digits",
]
LETTER = word_table(lambda b: 97 <= b <= 122 or b >= 128)
# Characters that stand in for letters.
LOOKS = LOWER.copy()
for _from, _to in zip(b"013457@$!|", b"oieastasil"):
    LOOKS[_from] = _to
STAND_IN = LOOKS != LOWER
CAPITAL = word_table(lambda b: 65 <= b <= 90)
DIGIT = word_table(lambda b: 48 <= b <= 57)
SYMBOL = word_table(lambda b: b in b"#$%&*@^~_+=<>|\\")


def terms(column: pa.Array):
    """For runs of rows: the bytes and, of plain and of look-alike spelling, word spans, first word of each row and hashes of words and beginnings."""
    for lo, hi, raw, off in byte_chunks(column):
        views = []
        for table in (LOWER, LOOKS):
            buf = table[raw]
            starts, ends, first = word_spans(buf, off, LETTER)
            h = prefix_hash(buf)
            views.append((starts, ends, first, span_hash(h, starts, ends), ~span_hash(h, starts, np.minimum(ends, starts + PREFIX))))
        yield lo, hi, raw, off, views


_you = np.frombuffer(" ".join(SECOND_PERSON).encode(), np.uint8)
_s, _e, _ = word_spans(_you, np.array([0, len(_you)]), LETTER)
YOU = np.sort(span_hash(prefix_hash(_you), _s, _e))


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def features(column: pa.Array, lexicon: np.ndarray):
    """(first row, end row, matrix of FEATURES) for runs of rows."""
    lexicon = np.sort(lexicon)
    for lo, hi, raw, off, ((starts, ends, first, words, heads), (s2, e2, f2, w2, _)) in terms(column):
        def per_row(flags, at=first):
            total = np.concatenate([[0], np.cumsum(flags)])
            return (total[at[1:]] - total[at[:-1]]).astype(float)

        def per_byte(flags):
            return per_row(flags, off)

        n = np.maximum(np.diff(first), 1).astype(float)
        length = np.maximum(np.diff(off), 1).astype(float)
        hit, head = among(words, lexicon), among(heads, lexicon) & (ends - starts > PREFIX)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        kinds = np.bincount(np.unique(np.stack([row[hit], np.searchsorted(lexicon, words[hit])]), axis=1)[0].astype(np.int64), minlength=hi - lo) if hit.any() else np.zeros(hi - lo)
        you = among(words, YOU)
        seen = np.concatenate([[0], np.cumsum(you)])
        where = np.flatnonzero(hit | head)
        low, high = np.maximum(where - NEAR, first[row[where]]), np.minimum(where + NEAR + 1, first[row[where] + 1])
        near = np.zeros(len(words), bool)
        near[where] = seen[high] > seen[low]
        stand = np.concatenate([[0], np.cumsum(STAND_IN[raw])])
        letters = np.concatenate([[0], np.cumsum(LETTER[LOWER[raw]])])
        mixed = (stand[e2] > stand[s2]) & (letters[e2] - letters[s2] > 1)
        hidden = mixed & among(w2, lexicon)
        big = np.concatenate([[0], np.cumsum(CAPITAL[raw])])
        shout = (big[ends] - big[starts] == ends - starts) & (ends - starts > 1)
        same = np.zeros(len(raw), bool)
        if len(raw) > 2:
            same[2:] = (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2]) & LETTER[LOWER[raw[2:]]]
        word_hits, prefix_hits = per_row(hit), per_row(head)
        yield lo, hi, np.stack([
            np.log1p(np.diff(off)), word_hits, word_hits / n, kinds, prefix_hits, prefix_hits / n, per_row(near), per_row(you) / n, per_row(hidden, f2), per_row(mixed, f2) / n,
            per_byte(CAPITAL[raw]) / length, per_row(shout) / n, per_byte(raw == 33) / length, per_byte(raw == 63) / length, per_byte(SYMBOL[raw]) / length,
            per_row(ends - starts == 1) / n, per_byte(same) / length, per_byte(DIGIT[raw]) / length,
        ], axis=1)


def remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic, fold): at most ``sample`` rows that may be learned from."""
    usable = labels.where((remainder(F.col("doc_id")) != 2) & F.col("toxic").isin(0, 1))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``sample`` rows of two numbers
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))


def learned_lexicons(rows: DataFrame) -> list[np.ndarray]:
    """Term hashes learned without each fold, and at the end those learned from all rows."""

    def run(batches):
        for batch in batches:
            toxic, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, _, _, ((_, _, first, words, heads), _) in terms(batch.column(0)):
                row = np.repeat(np.arange(lo, hi), np.diff(first))
                group = (fold[row] * 2 + toxic[row]).astype(np.uint64)
                both = np.unique(np.stack([np.tile(row, 2).astype(np.uint64), np.tile(group, 2), np.concatenate([words, heads])]), axis=1)
                pair, count = np.unique(both[1:], axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64)), pa.array(pair[0].astype(np.int32)), pa.array(count)], ["term", "g", "n"])

    counts = rows.select("text", F.col("toxic").cast("long"), F.col("fold").cast("long")).mapInArrow(run, "term long, g int, n long")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    per = counts.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("g") == g, F.col("n"))), F.lit(0)).alias(f"c{g}") for g in range(2 * FOLDS)])
    per = cut(per, "terms")
    lexicons = []
    for left_out in [*range(FOLDS), None]:
        used = [f for f in range(FOLDS) if f != left_out]
        bad, good = (sum(F.col(f"c{2 * f + t}") for f in used) for t in (1, 0))
        n_bad, n_good = (sum(sizes.get((f, t), 0) for f in used) for t in (1, 0))
        odds = F.log((bad + 0.1) / (n_bad + 1.0)) - F.log((good + 0.1) / (n_good + 1.0))
        best = per.select("term", bad.alias("bad"), odds.alias("odds")).where(f"bad >= {LEAST_DOCS} AND odds >= {LEAST_ODDS}")
        best = best.orderBy(F.col("bad").desc(), "term").limit(LEXICON)
        lexicons.append(best.select("term").toArrow()["term"].to_numpy().view(np.uint64))
    return lexicons


class ToxicityModel:
    def __init__(self, lexicon: np.ndarray, trees=None, calibration=None, share: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def _scored(self, docs: DataFrame) -> DataFrame:
        """``docs`` (any columns that a row of features may carry along, and text) without text, with ``score``."""
        lexicon, others = self.lexicon, [c for c in docs.columns if c != "text"]
        schema = with_features(docs, others)

        def run(batches):
            for batch in batches:
                for lo, hi, x in features(batch.column("text"), lexicon):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in others), pa.array(list(x))], [*others, "x"])

        rows = docs.mapInArrow(run, schema)
        if self.trees is None:
            scored = rows.withColumn("score", F.lit(float(self.share)))
        else:
            raw = self.trees.transform(rows.withColumn("features", array_to_vector("x"))).withColumn("raw", vector_to_array("probability")[1])
            scored = self.calibration.transform(raw.select(*others, "raw"))
        return scored.select(*others, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))

    def score(self, docs: DataFrame) -> DataFrame:
        """Rows (doc_id, held_out, score, predicted)."""
        scored = self._scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
        held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
        return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that are not predicted toxic. Rows travel with their features, so there is no join."""
        scored = self._scored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"))
        return scored.where(F.col("score") < THRESHOLD).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def with_features(docs: DataFrame, others: list[str]) -> StructType:
    return StructType([docs.schema[c] for c in others] + [StructField("x", ArrayType(DoubleType()))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    rows = cut(labelled(docs, labels, sample), "labelled")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    # The fold that calibrates: it and the rest must both hold both classes.
    usable = [f for f in range(FOLDS) if all((f, t) in sizes and any((g, t) in sizes for g in range(FOLDS) if g != f) for t in (0, 1))]
    if not usable:
        total = sum(sizes.values())
        return ToxicityModel(np.zeros(0, np.uint64), share=sum(n for (_, t), n in sizes.items() if t == 1) / total if total else 0.0)
    held = usable[0]
    lexicons = learned_lexicons(rows)

    def run(batches):
        for batch in batches:
            fold = batch.column(2).to_numpy()
            x = np.empty((batch.num_rows, len(FEATURES)))
            for f in range(FOLDS):
                at = np.flatnonzero(fold == f)
                if len(at):
                    x[at] = np.concatenate([m for _, _, m in features(batch.column(0).take(pa.array(at)), lexicons[f])])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x))], ["toxic", "fold", "x"])

    table = rows.select("text", F.col("toxic").cast("double").alias("toxic"), "fold").mapInArrow(run, "toxic double, fold int, x array<double>")
    table = cut(table, "features").withColumn("features", array_to_vector("x"))
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=42)
    fitted = trees.fit(table.where(F.col("fold") != held).coalesce(4))
    seen = fitted.transform(table.where(F.col("fold") == held)).select("toxic", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="score").fit(seen)
    return ToxicityModel(lexicons[-1], fitted, calibration)
