"""Mixing to target weights with soft domain membership.

A classifier learned from a table of labels gives every document a posterior over domains. Document rates are then
fitted by least squares: nonnegative rates whose expected token totals by domain, ``sum rate * tokens * posterior``,
come closest to the targets. Projected gradient steps run over the distributed documents; a step only moves one
number per domain, so a document's rate is a function of its posterior and of the steps so far, and the iteration
needs no state on executors. A rate of 1.3 means one copy, and a second one for three documents in ten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, rows_of, written

BITS = 13
#: Words whose bins a worker keeps.
MOST_WORDS = 200_000
#: Standard errors by which a domain must use a word bin more or less than all do for the bin to count.
LEAST_SURE = 4.0
BAGS = "doc_id long, copy long, n_tokens long, bins binary"
SOFT = "doc_id long, copy long, n_tokens long, posteriors array<double>"
SUMS = "domain string, bin int, n long"
#: Domains of the labels table, and what to aim for.
LABEL_DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN 'good' END"
TARGETS = {"good": 0.93, "low": 0.06, "toxic": 0.01}
#: A domain's miss is measured by its target, or by this share of all targets where that is more.
LEAST_SHARE, TOLERANCE = 1e-3, 0.01


def word_bags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy, n_tokens, bins): words at white space, and the hashed bins of the distinct ones.

    A word counts without the marks around it, and the marks count apart: junk shows by its marks.
    """
    def make():
        import xxhash

        from .byte_words import Kept

        hashed = lambda x: xxhash.xxh64_intdigest(x) >> (64 - BITS)
        marks = b"\"'.,;:!?()[]{}<>*#$%&|-_~/\\"

        def both(word: bytes) -> int:
            bare = word.strip(marks)
            return hashed(bare) | hashed(b" " + word.lstrip(marks)[len(bare):]) << 16

        table = Kept(both)

        def run(batches) -> Iterator[tuple]:
            for doc_id, copy, text in rows_of(batches):
                words = (text or "").lower().encode("utf-8", "surrogatepass").split()
                pairs = np.fromiter(map(table.__getitem__, words), np.uint32, len(words))
                bins = np.unique(pairs.view(np.uint16))
                table.trim(MOST_WORDS)
                yield doc_id, copy, len(words), bins.astype("<u2").tobytes()

        return run

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("copy"),
                         F.col(text_col).alias("text"))
    return arrow_map(source, make, BAGS)


def learn_domains(bags: DataFrame, labels: DataFrame, domain: str = LABEL_DOMAIN,
                  id_col: str = "doc_id") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(domains, their scores for a text without words, weights by domain and bin) from all labelled documents.

    Both what a text has and what it lacks count: the score of a text without words holds the priors and the lack of
    every telling bin, and a bin's weight exchanges its lack for its presence. Bins are counted by domain inside the tasks and summed by a shuffle, so the driver gets one number per domain and
    bin. Rows without a domain are left out; an id labelled twice counts under its first domain by name.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(domain).alias("domain"))
             .filter("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain")))

    def make():
        def run(batches) -> Iterator[tuple]:
            sums: dict[str, np.ndarray] = {}
            for name, bins in rows_of(batches):
                own = sums.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))
                own[np.frombuffer(bins, "<u2")] += 1
                own[-1] += 1
            for name, own in sums.items():
                for place in np.flatnonzero(own).tolist():
                    yield name, place, int(own[place])

        return run

    counted = arrow_map(bags.join(known, "doc_id").select("domain", "bins"), make, SUMS)
    rows = counted.groupBy("domain", "bin").agg(F.sum("n").alias("n")).collect()
    domains = sorted({r.domain for r in rows})
    counts = np.zeros((len(domains), (1 << BITS) + 1))
    for r in rows:
        counts[domains.index(r.domain), r.bin] = r.n
    size, counts = counts[:, -1:], counts[:, :-1]
    overall = (counts.sum(axis=0) + 1) / (size.sum() + 2)
    own = (counts + 1) / (size + 2)
    sure = np.abs(own - overall) / np.sqrt(overall * (1 - overall) / np.maximum(size, 1)) >= LEAST_SURE
    present = np.where(sure, np.log(own / overall), 0.0)
    absent = np.where(sure, np.log((1 - own) / (1 - overall)), 0.0)
    priors = np.log(size[:, 0] / size.sum()) if len(domains) else np.zeros(0)
    return domains, priors + absent.sum(axis=1), present - absent


def posteriors(bags: DataFrame, bare: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(doc_id, copy, n_tokens, posteriors) in the order of the learned domains."""
    def make():
        def run(batches) -> Iterator[tuple]:
            for doc_id, copy, n_tokens, bins in rows_of(batches):
                scores = bare + weights[:, np.frombuffer(bins, "<u2")].sum(axis=1)
                odds = np.exp(scores - scores.max()) if len(scores) else scores
                yield doc_id, copy, n_tokens, (odds / odds.sum()).tolist() if len(odds) else []

        return run

    return arrow_map(bags, make, SOFT)


def rate_after(steps: list[np.ndarray]) -> Column:
    """The rate of a document after gradient steps from rate 1, each projected to zero or more."""
    if not steps:
        return F.lit(1.0)
    moves = ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in step) + ")" for step in steps)
    return F.expr(f"""aggregate(array({moves}), 1.0D, (rate, step) -> greatest(0.0D, rate - aggregate(
        zip_with(posteriors, step, (p, s) -> p * s), 0.0D, (a, b) -> a + b)))""")


def fit_rates(soft: DataFrame, targets: np.ndarray, tolerance: float = 0.01, most_passes: int = 60
              ) -> tuple[list[np.ndarray], np.ndarray]:
    """(steps, expected token totals by domain): projected-gradient least squares for totals near ``targets``.

    Rates are measured in units of a document's tokens, residuals in units of each domain's own target. A step goes
    along the gradient scaled by the second moments of the documents whose rate is above zero; where that, or a
    shorter one, brings the totals no nearer, a plain gradient step of the safe length does. Stops when every total is
    within ``tolerance`` of its own target, when no step helps (the targets can't be reached then, and these totals
    are the nearest found), or after ``most_passes`` passes over the documents.
    """
    size = len(targets)
    units = own_units(targets)
    pairs = [(a, b) for a in range(size) for b in range(a, size)]
    part = lambda a: F.get("posteriors", F.lit(a))
    open_tokens = F.when(F.col("rate") > 0, F.col("n_tokens")).otherwise(0)

    def measured(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = soft.withColumn("rate", rate_after(steps)).agg(
            *[F.sum(F.col("rate") * F.col("n_tokens") * part(a)) for a in range(size)],
            *[F.sum(open_tokens * part(a) * part(b)) for a, b in pairs]).first()
        found = np.array([x or 0.0 for x in row])
        gram = np.zeros((size, size))
        for (a, b), x in zip(pairs, found[size:]):
            gram[a, b] = gram[b, a] = x
        return found[:size], gram / np.outer(units, units)

    steps: list[np.ndarray] = []
    totals, gram = measured(steps)
    steepest = max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)  # at rate 1 all documents count
    passes, length = 1, 1.0
    while passes < most_passes:
        residual = (totals - targets) / units
        if np.abs(residual).max() <= tolerance:
            break
        scaled = np.linalg.pinv(gram + 1e-9 * max(np.trace(gram), 1e-9) * np.eye(size)) @ residual
        for factor in (length, length / 2, length / 4, 0.0):
            step = (factor * scaled if factor else residual / steepest) / units
            reached, moments = measured([*steps, step])
            passes += 1
            if np.linalg.norm((reached - targets) / units) < np.linalg.norm(residual) * (1 - 1e-3):
                steps, totals, gram = [*steps, step], reached, moments
                length = min(1.0, 2 * factor) if factor else length / 4
                break
        else:
            break
    return steps, totals


def own_units(targets: np.ndarray) -> np.ndarray:
    """What a domain's miss is measured by: its target, and a thousandth of all targets where it has less."""
    return np.maximum(targets, max(float(targets.sum()), 1.0) * LEAST_SHARE)


def copies(rate: Column, *key: str) -> Column:
    """Whole copies for a rate: its floor, and one more for a share of documents chosen by their key's hash."""
    uniform = F.xxhash64(*key, F.lit("copies")).bitwiseAND(0xFFFFFFFF) / float(2**32)
    return (F.floor(rate) + (uniform < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, scale: float = 1.0,
        domain: str = LABEL_DOMAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy, n_tokens, domain, posterior, rate, copies, target, reached, met) for every row of ``docs``.

    Tokens are words at white space. ``target`` and ``reached`` are the expected tokens aimed at and fitted for the
    row's likeliest domain, ``met`` tells whether *every* domain is within one percent of its own target (of a
    thousandth of all targets, for smaller ones): false where the targets can't be reached by rates of zero or more.
    ``targets`` are the domains' weights; their sum is scaled to ``scale`` times the tokens of ``docs``. Domains that
    nobody labelled can't be aimed at and raise nothing: their weight goes to the others. ``copy`` tells rows of
    equal id and different text apart. Null and empty texts have no tokens and the posterior of a text without words. Without any label
    all rates are 1 and the last three columns null. An empty table gives an empty one.
    """
    bags = written(word_bags(docs, id_col, text_col), "bags")
    domains, bare, weights = learn_domains(bags, labels, domain, id_col)
    soft = written(posteriors(bags, bare, weights), "posteriors")
    aims = np.array([(targets or TARGETS).get(name, 0.0) for name in domains])
    steps: list[np.ndarray] = []
    wanted, reached, met = np.zeros(0), np.zeros(0), None
    if aims.sum() > 0:
        tokens = float(soft.agg(F.sum("n_tokens")).first()[0] or 0)
        wanted = aims / aims.sum() * tokens * scale
        steps, reached = fit_rates(soft, wanted, TOLERANCE)
        met = bool((np.abs(reached - wanted) <= TOLERANCE * own_units(wanted)).all())
    likely = F.array_max("posteriors")
    place = (F.array_position("posteriors", likely) - 1).cast("int")

    def of_domain(values, kind: str) -> Column:
        return F.get(F.array(*map(F.lit, values)) if len(values) else F.expr(f"CAST(array() AS array<{kind}>)"), place)

    return soft.withColumn("rate", rate_after(steps)).select(
        "doc_id", "copy", "n_tokens", of_domain(domains, "string").alias("domain"),
        likely.alias("posterior"), "rate", copies(F.col("rate"), "doc_id", "copy").alias("copies"),
        of_domain(wanted.tolist(), "double").alias("target"), of_domain(reached.tolist(), "double").alias("reached"),
        F.lit(met).cast("boolean").alias("met"))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as ``mixed`` says. Same columns; equal rows count each for itself."""
    wanted = mixed.groupBy("doc_id", "copy").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct("*").alias("row")).withColumn("hash", F.xxhash64(F.col("row")[text_col]))
    kept = rows.join(wanted, F.col("row")[id_col].eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("copy"))
                     ).filter("copies > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
