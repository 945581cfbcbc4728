"""Personal data: generators of high recall propose overlapping spans, boosted trees choose among them.

The base kinds (email, ip, card, phone) are found by their patterns and checks and always stay. Wider generators propose
more: obfuscated addresses, telephone numbers without a plus, account and social-security numbers. A candidate becomes a
vector of its format (lengths, digits, separators, groups, checksums of the wider kinds) and its context (cue words and hashed
words before it, neighbouring characters), and boosted trees score it. Of overlapping candidates the best scored stays, and none
overlaps a base span.

Training: the candidates of all documents, in rounds of Spark jobs: each level of a tree is one sum over all rows, calibration and
thresholds are counts of all rows by score. A label says where a value stands, not what it looks like, so no feature gives it
away: where a document has a base span, a value of a related wider kind in its place is personal data; values strewn elsewhere,
and numbers that the documents hold themselves, are not; well-formed and malformed values are among both. Base candidates are
learned by their context alone (their own check is no feature). `n_examples` seeded examples add contexts that documents may lack,
cues among both labels; each counts as often as it takes for them to weigh about SHARE of the documents' candidates or more. Texts
(equal ones together) and examples are dealt to three folds: one fits the trees, one calibrates their scores, and on the third
a kind's threshold is the least score from which on the precision is at least `precision`. Neither the order nor the partitions of
the documents change the model.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive; repeated rows are scanned each;
other columns are ignored; an empty table gives an empty result and a model of the seeded examples alone.
"""

from __future__ import annotations

import random
import re
import uuid
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import boosting
from .common import each_text, remove, shared_dir, small_batches, text_of

Span = tuple[str, int, int]

# The base patterns.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Runs of digits joined by dots; every four runs of a chain are a candidate.
CHAIN, RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}"), re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The wider generators.
WIDE = {
    "email_spelled": re.compile(r"\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]+)+", re.IGNORECASE | re.ASCII),  # after the local part
    "phone_local": re.compile(r"(?<![\w+.])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?!\w)", re.ASCII),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", re.ASCII),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![\w-])", re.ASCII),
}
#: What every match of email_spelled holds.
SPELLED_AT = re.compile(r"[\[(]at[\])]", re.IGNORECASE | re.ASCII)
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *WIDE)
#: Words before a span that tell its kind.
CUES = [
    re.compile(p, re.IGNORECASE)
    for p in (r"mail|contact|write to|reach", r"\bip\b|host|server|address", r"card|visa|credit|master", r"phone|tel|call|mobile|fax|cell", r"iban|bank|account", r"ssn|social sec", r"order|invoice|version|date|isbn|page|ticket|build|item")
]
DIGIT, BEFORE = re.compile("[0-9]"), 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _local(text: str, at: int, end: int) -> int:
    """Where the run of characters of a local part that ends before `at` begins, from `end` on."""
    while at > end and text[at - 1] in LOCAL_CHARS:
        at -= 1
    return at


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping: the local part is the run before an @, from the end of the last match on."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = _local(text, at, end)
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", a, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return out


def spelled(text: str) -> list[Span]:
    """Addresses with their signs spelled out; a local part begins with a letter, digit or underscore."""
    out, end = [], 0
    for m in WIDE["email_spelled"].finditer(text):
        a = _local(text, m.start(), end)
        while a < m.start() and text[a] in ".%+-":
            a += 1
        if a < m.start():
            out.append(("email_spelled", a, end := m.end()))
    return out


LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _low(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255


def numbers(text: str) -> tuple[list[Span], list[Span]]:
    """ip, card and phone spans, and those that match a pattern but fail its check."""
    good: list[Span] = []
    bad: list[Span] = []
    for m in CHAIN.finditer(text):
        runs = [r.span() for r in RUN.finditer(text, *m.span())]
        for four in zip(*[iter(runs)] * 4):  # noqa: B905: what is left of a chain is none
            (good if all(_low(text[a:b]) for a, b in four) else bad).append(("ip", four[0][0], four[3][1]))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19:
            (good if luhn(digits) else bad).append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            (good if 9 <= len(DIGIT.findall(m[0])) <= 15 else bad).append(("phone", *m.span()))
    return good, bad


def base_and_rest(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans; the other candidates, overlapping as they may."""
    has_digit, has_spelled = DIGIT.search(text), ("(" in text or "[" in text) and SPELLED_AT.search(text)
    if not has_digit and "@" not in text and not has_spelled:
        return [], []
    good, bad = numbers(text) if has_digit else ([], [])
    good = emails(text) + good if "@" in text else good
    return good, bad + wide(text, bool(has_digit), bool(has_spelled))


def wide(text: str, has_digit: bool = True, has_spelled: bool = True) -> list[Span]:
    out = spelled(text) if has_spelled else []
    if has_digit:
        out += [(kind, *m.span()) for kind, pattern in WIDE.items() if kind != "email_spelled" for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate. The check of a base kind is left out: it is what its label says."""
    kind, a, b = span
    s, before = text[a:b], text[max(0, a - BEFORE) : a]
    digits = "".join(DIGIT.findall(s))
    letters = sum(c.isalpha() for c in s)
    groups = [len(g) for g in re.split("[^0-9A-Za-z]+", s) if g]
    tight = re.sub("[^0-9A-Z]", "", s)
    checked = (kind == "iban" and 15 <= len(tight) <= 34 and mod97(tight)) or (kind == "ssn" and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    near = {zlib.crc32(w.encode()) % HASHED for w in re.findall(r"[^\W\d_]+", before.lower())[-3:]}
    return [
        float(KINDS.index(kind)), *(float(kind == k) for k in KINDS), len(s), len(digits), letters, len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, float(checked), len(set(digits)),
        float("(" in s), float("." in s), float("-" in s), float(" " in s), float(a > 0 and text[a - 1].isalnum()), float(b < len(text) and text[b].isalnum()), *(float(bool(c.search(before))) for c in CUES),
        *(float(i in near) for i in range(HASHED)),
    ]


#: Buckets for the words before a candidate.
HASHED = 16
N_FEATURES = len(KINDS) + 16 + len(CUES) + HASHED
#: Which wider kinds a value of a base kind may be written as.
RELATED = {"email": ("email_spelled",), "phone": ("phone_local",), "card": ("iban", "ssn"), "ip": ("ssn", "phone_local")}


def value(kind: str, rng: random.Random, well: bool) -> str:
    """A value of a wider kind, well-formed or not."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    if kind == "email_spelled":
        at, dot = rng.choice((("(at)", "(dot)"), ("[at]", "[dot]"), ("(AT)", "(DOT)")))
        dot = rng.choice((f" {dot} ", ".")) if well else "."
        return f"{rng.choice(('jo', 'ana', 'max'))}{d(2) if rng.random() < 0.5 else ''} {at} {rng.choice(('mail', 'post'))}{dot}{rng.choice(('org', 'net'))}"
    if kind == "phone_local":
        return rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)} {d(3)} {d(3)}")) if well else rng.choice((f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(4)} {d(4)}", f"{d(2)}/{d(2)}/20{d(2)}"))
    if kind == "iban":
        body = d(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}" if well else f"{rng.choice(('DE', 'QX', 'AB'))}{d(20)}"
    return f"{rng.choice('12345')}{d(2)}-{rng.choice('123456789')}{d(1)}-{rng.choice('123456789')}{d(3)}" if well else f"{rng.choice(('000', '666', '9' + d(2)))}{rng.choice('- ')}{d(2)}{rng.choice('- ')}{d(4)}"


def placed(left: str, inserted: str, right: str) -> list[list[float]]:
    """Features of the wider candidates that lie in what is inserted."""
    text, a = left + inserted + right, len(left)
    return [features(text, s) for s in wide(text) if s[1] >= a and s[2] <= a + len(inserted)]


def lessons(text: str, seed: int, strewn: int = 4) -> Iterator[tuple[list[float], float]]:
    """Labelled candidates of one document: all its base spans and failed ones, a value in place of each base span, values strewn elsewhere, its own numbers."""
    good, bad = base_and_rest(text)
    rng = random.Random(f"{seed}:{zlib.crc32(text.encode('utf-8', 'surrogatepass'))}:{len(text)}")
    yield from ((features(text, s), 1.0) for s in good)
    yield from ((features(text, s), 0.0) for s in bad)
    for kind, a, b in good:
        inserted = value(rng.choice(RELATED[kind]), rng, rng.random() < 0.9)
        yield from ((x, 1.0) for x in placed(text[max(0, a - 2 * BEFORE) : a], inserted, text[b : b + BEFORE]))
    for _ in range(strewn if text else 0):
        at = text.find(" ", rng.randrange(len(text))) + 1
        if not any(a - BEFORE < at < b + BEFORE for _, a, b in good):
            inserted = value(rng.choice(tuple(WIDE)), rng, rng.random() < 0.15)
            yield from ((x, 0.0) for x in placed(text[max(0, at - 2 * BEFORE) : at], inserted, " " + text[at : at + BEFORE]))


#: Leads of the seeded examples, by kind; each also stands before values that aren't personal data, and those before personal ones.
LEADS = {
    "email_spelled": (("mail me: ", "contact ", "reach me: ", "write to "), ("see you ", "we met ", "the ", "lunch with ")),
    "phone_local": (("call ", "phone: ", "tel ", "my mobile is "), ("order ", "invoice ", "on ", "the ")),
    "iban": (("IBAN ", "bank account ", "pay to "), ("item ", "build ", "the ")),
    "ssn": (("SSN ", "social security "), ("page ", "order ", "the ", "")),
}


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeded examples of the wider kinds, whether they are personal data, and their folds (0 to 9); of either, one in a hundred has the other's lead and one in twelve the other's form."""
    rng = random.Random(seed)
    rows, marks, folds = [], [], []
    for i in range(n):
        fold, good, kind = rng.randrange(10), bool(i % 2), tuple(WIDE)[i // 2 % len(WIDE)]
        lead, well = good != (rng.random() < 1 / 100), good != (rng.random() < 1 / 12)
        for x in placed(f"Words before, {rng.choice(LEADS[kind][not lead])}", value(kind, rng, well), rng.choice((" and after.", " please", ".", " ORG"))):
            rows.append(x)
            marks.append(good)
            folds.append(fold)
    return np.array(rows), np.array(marks), np.array(folds)


class Redactor(NamedTuple):
    model: boosting.Model
    thresholds: dict[str, float]

    def choose(self, texts: list[str]) -> list[tuple[list[Span], list[tuple[Span, float]]]]:
        """For each text its base spans and the added ones with their scores; candidates of a batch are scored together."""
        found = [base_and_rest(t) for t in texts]
        rows = [features(t, s) for t, (_, rest) in zip(texts, found, strict=True) for s in rest]
        scores = iter(boosting.predict(self.model, np.array(rows)).tolist() if rows else [])
        out = []
        for base, rest in found:
            ranked = sorted(((next(scores), s) for s in rest), key=lambda x: (-x[0], x[1][1], x[1][2], KINDS.index(x[1][0])))
            out.append((base, disjoint(base, [(s, p) for p, s in ranked if p >= self.thresholds[s[0]]])))
        return out


def disjoint(base: list[Span], ranked: list[tuple[Span, float]]) -> list[tuple[Span, float]]:
    """The ranked spans that overlap neither a base span nor a better one; in n log n for what is kept in order."""
    taken: list[tuple[int, int]] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):  # base kinds may overlap each other: hold their union
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    kept = []
    for span, p in ranked:
        i = bisect_left(taken, (span[1], span[2]))
        if (i == len(taken) or taken[i][0] >= span[2]) and (i == 0 or taken[i - 1][1] <= span[1]):
            insort(taken, (span[1], span[2]))
            kept.append((span, p))
    return sorted(kept, key=lambda x: x[0][1])


#: Labelled candidates: features, label, fold, and whether it is of a seeded example.
LESSONS = "x array<int>, y int, fold int, seeded boolean"
#: Weight of all examples, if they are outnumbered, as a share of the documents' candidates; each counts a whole number of times.
SHARE = 0.4
#: Folds from these on calibrate and set thresholds.
CALIBRATES, DECIDES = 6, 8
#: Rows that are handed on or summed at once; rows of a task of the training.
AT_ONCE, BLOCK, TASK = 2000, 1 << 15, 50_000


def _batches(rows: Iterable[tuple[list[float], float, int]], seeded: bool) -> Iterator[pa.RecordBatch]:
    """Arrow batches of LESSONS, of bounded size."""
    kept: list[tuple[list[float], float, int]] = []

    def flush():
        x = np.array([r[0] for r in kept], np.int32)
        ends = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * x.shape[1])
        others = (pa.array([int(r[1]) for r in kept], pa.int32()), pa.array([r[2] for r in kept], pa.int32()), pa.array([seeded] * len(kept)))
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel())), *others], ["x", "y", "fold", "seeded"])

    for row in rows:
        kept.append(row)
        if len(kept) == AT_ONCE:
            yield flush()
    if kept:
        yield flush()


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    """The features of a batch, one after the other."""
    return np.ascontiguousarray(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).T)


def labelled(docs: DataFrame, n_examples: int, seed: int) -> DataFrame:
    """LESSONS of all documents and the seeded examples; equal texts share a fold."""

    def of_texts(batches):
        yield from _batches(((x, y, fold) for b in batches for text, fold in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x, y in lessons(text, seed)), False)

    def of_examples(batches):
        for _ in batches:
            yield from _batches(zip(*(a.tolist() for a in examples(n_examples, seed)), strict=True), True)

    texts = small_batches(docs).select(text_of().alias("text")).select("text", F.pmod(F.xxhash64("text"), F.lit(10)).cast("int"))
    return texts.mapInArrow(of_texts, LESSONS).union(docs.sparkSession.range(0, 1, 1, 1).mapInArrow(of_examples, LESSONS))


def grid_of(rows: DataFrame) -> list[np.ndarray]:
    """The cuts of each feature over all rows and their weights, as boosting.cuts_of; a feature has few distinct values, lengths the most."""
    counts = rows.select("weight", F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").agg(F.sum("weight").alias("n"))
    feature = Window.partitionBy("feature")
    upto = F.sum("n").over(feature.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select("feature", "value", "n", upto.alias("upto"), F.sum("n").over(feature).alias("n_all"), F.count("*").over(feature).alias("n_values"))
    steps = F.expr(f"upto * {boosting.BINS} div n_all > (upto - n) * {boosting.BINS} div n_all")
    cuts = counts.where((F.col("upto") < F.col("n_all")) & ((F.col("n_values") <= boosting.BINS) | steps)).select("feature", "value").collect()
    found: list[list[int]] = [[] for _ in range(N_FEATURES)]
    for feature, value in cuts:
        found[feature].append(value)
    return [np.array(sorted(values), int) for values in found]


def trees_of(rows: DataFrame, n_rows: int, good: int, weight: int) -> boosting.Model:
    """Trees from all the rows, not calibrated: a level of a tree is one sum over all of them."""
    grid, start = grid_of(rows), boosting.start_of(good, weight)

    def blocks(batches):
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            bins, y, w = (np.concatenate(part, axis=-1) for part in zip(*kept, strict=True))
            kept.clear()
            return pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "y": [y.astype(np.uint8).tobytes()], "weight": [w.astype(np.int64).tobytes()]})

        for b in batches:
            kept.append((boosting.binned(_columns(b), grid), b.column("y").to_numpy(), b.column("weight").to_numpy()))
            if sum(len(y) for _, y, _ in kept) >= BLOCK:
                yield flush()
        if kept:
            yield flush()

    tasks = max(1, -(-n_rows // TASK))
    held = rows.select("x", "y", "weight").coalesce(tasks).mapInArrow(blocks, "bins binary, y binary, weight binary").rdd.map(tuple).persist(StorageLevel.DISK_ONLY)

    def measure(trees, tree, level):
        def of(part):
            total = None
            for bins, y, w in part:
                found = boosting.sums(np.frombuffer(bins, np.uint8).reshape(N_FEATURES, -1), np.frombuffer(y, np.uint8), np.frombuffer(w, np.int64), start, trees, tree, level)
                total = found if total is None else (total[0] + found[0], total[1] + found[1])
            if total is not None:
                yield total

        return held.mapPartitions(of).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))

    try:
        made = boosting.grow(measure, np.array([len(cuts) for cuts in grid]))
    finally:
        held.unpersist()
    return boosting.Model(start, boosting.unbinned(made, grid), np.zeros(0), np.zeros(0))


class Counted(NamedTuple):
    """Rows by kind and score: how many, their weight, the weight of those that are personal data."""

    kind: np.ndarray
    score: np.ndarray
    n: np.ndarray
    weight: np.ndarray
    good: np.ndarray


def counted(rows: DataFrame, model: boosting.Model) -> tuple[Counted, Counted]:
    """All rows that calibrate and all that decide, counted by kind and score: scores are few, see boosting."""

    def run(batches):
        for b in batches:
            x = _columns(b)
            score = np.rint(boosting.raw(model, x.T) * boosting.UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("fold"), pa.array(x[0].astype(np.int32)), pa.array(score), b.column("weight"), b.column("y")], ["fold", "kind", "score", "weight", "y"])

    scored = rows.mapInArrow(run, "fold int, kind int, score long, weight long, y int").groupBy((F.col("fold") >= DECIDES).alias("decides"), "kind", "score")
    found = scored.agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("y")).alias("good")).collect()
    parts = ([r[1:] for r in found if r.decides == decides] for decides in (False, True))
    held, decide = (np.array(part, np.int64).reshape(-1, 5).T for part in parts)
    return Counted(held[0], held[1] / boosting.UNIT, *held[2:]), Counted(decide[0], decide[1] / boosting.UNIT, *decide[2:])


def fit(docs: DataFrame, n_examples: int = 8000, precision: float = 0.98, seed: int = 6) -> Redactor:
    """The redactor, trained on the candidates of all documents and the seeded examples."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pii-{uuid.uuid4().hex}"
    try:
        labelled(docs, n_examples, seed).write.parquet(path)
        return learnt(spark, path, precision)
    finally:
        remove(spark, path)


def learnt(spark: SparkSession, path: str, precision: float) -> Redactor:
    """The redactor of the LESSONS at `path`."""
    rows = spark.read.schema(LESSONS).parquet(path)
    sizes = {(r.seeded, r.trains): r for r in rows.groupBy("seeded", (F.col("fold") < CALIBRATES).alias("trains")).agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect()}
    of = {seeded: sum(r.n for (s, _), r in sizes.items() if s == seeded) for seeded in (False, True)}
    times = weight_of(of[False], of[True])
    rows = rows.withColumn("weight", F.when(F.col("seeded"), F.lit(times)).otherwise(F.lit(1)).cast("long"))
    own = [(r, times if seeded else 1) for (seeded, trains), r in sizes.items() if trains]
    model = trees_of(rows.where(F.col("fold") < CALIBRATES), sum(r.n for r, _ in own), sum(r.good * w for r, w in own), sum(r.n * w for r, w in own))
    held, decide = counted(rows.where(F.col("fold") >= CALIBRATES), model)
    score, at = np.unique(held.score, return_inverse=True)
    model = boosting.calibrate(model, score, np.bincount(at, held.good, len(score)), np.bincount(at, held.weight, len(score)))
    return Redactor(model, thresholds(model, decide, precision))


def weight_of(n_candidates: int, n_seeded: int) -> int:
    """How often each seeded example counts."""
    return max(1, round(SHARE * n_candidates / max(1, n_seeded)))


def thresholds(model: boosting.Model, rows: Counted, precision: float, least: int = 20) -> dict[str, float]:
    """For each kind the least calibrated score from which on `least` rows or more of the given fold reach the precision; above 1 if none."""
    scores, out = boosting.calibrated(model, rows.score), {}
    for i, kind in enumerate(KINDS):
        own = rows.kind == i
        p, at = np.unique(scores[own], return_inverse=True)
        n, weight, good = (np.bincount(at, of[own], len(p))[::-1].cumsum()[::-1] for of in (rows.n, rows.weight, rows.good))  # from each score on
        fits = p[(p > 0.5) & (n >= least) & (good >= precision * weight)]
        out[kind] = float(fits[0]) if len(fits) else 2.0
    return out


def find_pii(docs: DataFrame, redactor: Redactor | None = None) -> DataFrame:
    """doc_id, base and added: arrays of spans, the added ones with their calibrated score."""
    redactor = redactor or fit(docs)

    def rows(texts):
        for base, added in redactor.choose(texts):
            yield [{"kind": k, "start": a, "stop": b} for k, a, b in base], [{"kind": k, "start": a, "stop": b, "score": p} for (k, a, b), p in added]

    return each_text(docs, lambda texts: list(rows(texts)), "base array<struct<kind: string, start: int, stop: int>>, added array<struct<kind: string, start: int, stop: int, score: double>>")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are covered once, by the first kind."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])
