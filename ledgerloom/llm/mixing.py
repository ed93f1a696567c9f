"""Document rates that bring a corpus to target shares of domains (operator 9)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage

# Shares of tokens that the registered query and the pipeline aim at, by language.
TARGETS = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
STEPS = 30
TOLERANCE = 1e-6
# No document is taken more often than this.
MOST_RATE = 50.0

# Letters and frequent words whose counts tell these languages apart.
MARKERS = (
    " the ", " of ", " and ", " to ", "th", "wh", " der ", " die ", " und ", " mit ", "ch", "ß", "ü", "ä", "ö",
    " le ", " les ", " et ", " est ", "eau", "ç", "è", "ê", "é", " el ", " los ", " que ", " y ", "ñ", "ó", "í",
)


def marker_counts(text: Column) -> Column:
    """How often each marker stands in the text, as an array; with the number of other characters last."""
    size = F.octet_length(text)
    counts = [((size - F.octet_length(F.replace(text, F.lit(m), F.lit("")))) / len(m.encode())).cast("double") for m in MARKERS]
    return F.array(*counts, size.cast("double"))


def fit_domains(rows: DataFrame, domains: list[str]) -> dict[str, list[float]]:
    """Log weights of each domain: prior, then one per marker, from labelled rows (domain, counts).

    A multinomial model with one added count; one aggregate gives all its sums. The result has
    as many numbers as domains times markers, whatever the size of the corpus. Domains without
    a labelled row are left out.
    """
    width = len(MARKERS) + 1
    sums = rows.groupBy("domain").agg(F.count("*").alias("n"), *[F.sum(F.col("counts")[i]).alias(f"s{i}") for i in range(width)])
    found = {r.domain: r for r in sums.where(F.col("domain").isin(domains)).collect()}
    total = sum(r.n for r in found.values())
    model = {}
    for d in domains:
        if d not in found:
            continue
        r = found[d]
        counts = [(r[f"s{i}"] or 0.0) + 1.0 for i in range(width)]
        whole = sum(counts)
        prior = math.log((r.n + 1) / (total + len(found)))
        model[d] = [prior, *[math.log(c / whole) for c in counts]]
    return model


def domain_scores(counts: Column, model: Mapping[str, list[float]]) -> Column:
    """Log likelihood of each domain, in the model's order."""
    return F.array(*[sum([counts[i] * F.lit(x) for i, x in enumerate(w[1:])], F.lit(w[0])) for w in model.values()])


def posteriors(scores: str, domains: int) -> list[Column]:
    """Share of each domain in the document's membership; they add up to 1.

    Scores are softened, so that a text is rarely a member of one domain only.
    """
    top = F.array_max(scores)
    weights = [F.exp(F.greatest((F.col(scores)[i] - top) / 4, F.lit(-30.0))) for i in range(domains)]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def _memberships(rows: DataFrame, model: Mapping[str, list[float]], names: list[str], *kept: str) -> DataFrame:
    if not model:
        return rows.select(*kept, *[F.lit(0.0).alias(n) for n in names])
    rows = rows.select(*kept, domain_scores(F.col("_counts"), model).alias("_scores"))
    shares = {f"p_{d}": p for d, p in zip(model, posteriors("_scores", len(model)))}
    return rows.select(*kept, *[shares.get(n, F.lit(0.0)).alias(n) for n in names])


def fit_rates(
    staged: DataFrame, shares: list[str], targets: list[float], floor: float = 0.0, steps: int = STEPS, most: float = MOST_RATE
) -> tuple[Column, list[float]]:
    """Rate of each document as an expression over its ``shares``, by projected gradient, and the tokens each target lacks.

    Minimises the squared distance between the expected tokens of each domain, the sum over
    documents of rate * tokens * share, and its target, over rates from ``floor`` to ``most``. All
    rates start at 1. A step adds up one number per domain over all documents, divides the gap
    by the domain's tokens and moves every rate by minus its shares' gaps, then back into
    its bounds. Rates are a function of the shares and the few numbers of each step, so nothing per
    document is kept between steps, and each step is one scan of the staged table.
    """
    mass = staged.agg(*[F.sum(F.col("n_tokens") * F.col(p)).alias(p) for p in shares]).first()
    mass = [max(m or 0.0, 1e-9) for m in mass]
    rate = F.lit(1.0)
    for done in range(steps + 1):
        step = staged.withColumn("rate", rate).agg(*[F.sum(F.col("n_tokens") * F.col(p) * F.col("rate")).alias(p) for p in shares])
        now = step.first()
        now = [x or 0.0 for x in now]
        gaps = [(x - t) / m for x, t, m in zip(now, targets, mass)]
        lacks = [t - x for x, t in zip(now, targets)]
        if done == steps or max(map(abs, lacks)) <= TOLERANCE * max(sum(targets), 1.0):
            break
        move = sum([F.col(p) * F.lit(g) for p, g in zip(shares[1:], gaps[1:])], F.col(shares[0]) * F.lit(gaps[0]))
        rate = F.least(F.greatest(rate - move, F.lit(float(floor))), F.lit(float(most)))
    return rate, lacks


def token_count(text: Column) -> Column:
    """Words, parted by single spaces and line breaks; the tokens that the mix is measured in."""
    spaces = F.octet_length(text) - F.octet_length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(F.octet_length(text) == 0, F.lit(0)).otherwise(spaces + 1).cast("long")


def _counted(docs: DataFrame, *more: Column) -> DataFrame:
    """Key, tokens and marker counts of each document, from its id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*more, F.col("doc_id").cast("long").alias("_id"), text.alias("_text"))
    kept = rows.columns[: len(more)]
    return rows.select(*kept, F.xxhash64("_id", "_text").alias("_key"), token_count(F.col("_text")).alias("n_tokens"), marker_counts(F.col("_text")).alias("_counts"))


def _with_rates(rows: DataFrame, rate: Column) -> DataFrame:
    """Rate and copies; the draw for the rate's fraction comes from the document's key."""
    draw = F.shiftrightunsigned(F.xxhash64("_key", F.lit(7)), 1) / F.lit(float(1 << 63))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return rows.withColumn("rate", rate).withColumn("copies", copies.cast("long"))


def _fitted(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], keep_all: bool, steps: int, most: float):
    """Staged shares of every document, their names, the classifier, the rate and the share of tokens amiss."""
    domains = sorted(targets)
    names = [f"p_{d}" for d in domains]
    rows = stage(_counted(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("domain")), "mixing-counts")
    named = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    model = fit_domains(rows.join(named, "doc_id").withColumnRenamed("_counts", "counts"), domains)
    shared = stage(_memberships(rows, model, names, "doc_id", "_key", "n_tokens"), "mixing-shares")
    sums = shared.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col(p)).alias(p) for p in names]).first()
    total, wanted = float(sums["n"] or 0), [targets[d] / sum(targets.values()) for d in domains]
    if keep_all:
        total = max([total, *[(sums[p] or 0.0) / w for p, w in zip(names, wanted) if w > 0]])
    if not total or not model:
        return shared, names, model, F.lit(1.0), max(wanted) if total else 0.0
    rate, lacks = fit_rates(shared, names, [w * total for w in wanted], 1.0 if keep_all else 0.0, steps, most)
    return shared, names, model, rate, max(map(abs, lacks)) / total


def mixing_rates(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, keep_all: bool = True, steps: int = STEPS, most: float = MOST_RATE
) -> DataFrame:
    """Membership of each document in the target domains and the rate at which to take it.

    Documents named in ``labels`` (doc_id) that state a domain in ``lang`` train a classifier;
    it predicts every document's posteriors from its text alone. Rates from 0 to ``most`` are fitted
    so that the expected tokens of each domain match ``targets`` times all tokens; with
    ``keep_all`` the total is raised until no domain has to shrink and no rate is below 1.

    Returns (doc_id, n_tokens, p_<domain> ..., rate, residual, copies), a row per input row.
    ``residual``, alike in all rows, is the largest part of all wanted tokens by which a domain
    misses its target after ``steps`` steps: about 0 unless a target is out of reach. A domain that no labelled
    document states has no members and misses its whole target. ``copies`` is
    the rate's whole part, plus 1 with the probability of its fraction, drawn from a hash of
    doc_id and text. Null and empty texts have no tokens and the posteriors of no markers. Null
    labels and languages outside the targets are left out. With no tokens at all every rate is 1.
    Runs jobs when called.
    """
    shared, _, _, rate, residual = _fitted(docs, labels, targets, keep_all, steps, most)
    return _with_rates(shared, rate).withColumn("residual", F.lit(float(residual))).drop("_key")


def mix(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, keep_all: bool = True, steps: int = STEPS, most: float = MOST_RATE
) -> DataFrame:
    """The documents, each as often as its copies say, with their columns; nothing is shuffled and no text is staged.

    The fitted rate is an expression over the shares, which are evaluated again beside each row.
    """
    _, names, model, rate, _ = _fitted(docs, labels, targets, keep_all, steps, most)
    rows = _counted(docs, F.struct(*docs.columns).alias("row"))
    rows = _with_rates(_memberships(rows, model, names, "row", "_key"), rate)
    # No filter stands above the shares, as the optimizer would copy their expressions into every step of the rate.
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
