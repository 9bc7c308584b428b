"""Typed readers of result tables: exact headers, finite numbers, ranges, consistent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.functions import text as T
from kinset.operators import stats
from kinset.operators import threshold as R
from kinset.operators import validate as V
from kinset.sources import readers

# The headers of the two tables.
ACCURACY_HEADER = (
    "profile_id run_class target_security_bits cryptographic_profile nominal_security_bits security_match "
    "comparison_eligible comparison_scope primitive protocol_model output_semantics assurance_scope security_basis "
    "cost_scope precomputation_mode secure_division_included measurement_kind workload_id workload_manifest_sha256 "
    "execution_trace_sha256 root_seed omp_threads estimator_model sanitizer_model sanitizer_assurance "
    "transcript_stat_bits max_queries query_stat_bits coefficient_stat_bits flood_margin_bits eval_noise_bits "
    "flood_noise_bits actual_ring_dim log_q_bits plaintext_modulus num_limbs openfhe_version target_semantics "
    "target_jaccard realized_intersection realized_union realized_jaccard timing_trials accuracy_trials omp_dynamic "
    "measurement_status dataset variant dataset_manifest_sha256 records_sha256 pairs_sha256 pair_id pair_kind label "
    "record_a record_b k m hash_randomness accuracy_trial_index hash_seed set_size_a_raw set_size_b_raw "
    "set_size_a_bucketed set_size_b_bucketed exact_jaccard_raw exact_jaccard_bucketed estimated_jaccard "
    "bucket_match_fraction abs_error rel_error jaccard_bucket accuracy_workload_sha256"
).split()
THRESHOLD_HEADER = (
    "schema_version dataset variant dataset_manifest_sha256 records_sha256 pairs_sha256 pair_id pair_kind label "
    "record_a record_b k m hash_randomness root_seed split rank_position threshold_trial_index hash_seed match_count "
    "decision label_truth label_outcome exact_j_truth exact_j_outcome exact_jaccard_bucketed requested_j_threshold "
    "tau_count realized_j_tau calibration_fpr calibration_fnr calibration_balanced_error calibration_digest "
    "evaluation_digest threshold_workload_sha256"
).split()

SIZES = ("set_size_a_raw", "set_size_b_raw", "set_size_a_bucketed", "set_size_b_bucketed")
#: Seeds are unsigned 64-bit; the other whole numbers fit BIGINT.
SEEDS = ("root_seed", "hash_seed")
COUNTS = ("label", "rank_position", "threshold_trial_index", "match_count", "decision", "label_truth", "exact_j_truth", "k", "m", "tau_count")
SHARES = ("exact_jaccard_bucketed", "realized_j_tau", "requested_j_threshold")


def _faults(rows: DataFrame, path: str, rules: dict[str, Column]) -> None:
    """Raise for rows of which a rule does not hold; an unknown outcome is none that holds."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    V.demand(rows.select(broken.alias("broken"), "*").where(F.size("broken") > 0), f"{path} breaks its rules")


def accuracy_rows(spark: SparkSession, path: str, sized: tuple[str, ...] = ("enron",)) -> DataFrame:
    """(dataset, variant, exact_jaccard_bucketed, abs_error, record_a, record_b, four sizes).

    Both numbers are finite. Rows of datasets named in sized must have records and sizes of
    zero or more; other rows have null there where the cells do not hold such.
    """
    raw = readers.delimited(spark, path, readers.text_schema(*ACCURACY_HEADER))
    rows = raw.select(
        "dataset",
        "variant",
        *[T.strict_double(F.col(c)).alias(c) for c in ("exact_jaccard_bucketed", "abs_error")],
        *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("record_a", "record_b")],
        *[T.strict_integer(F.col(c)).alias(c) for c in SIZES],
    )
    needed = ~F.col("dataset").isin(*sized)
    rules = {c: F.col(c).isNotNull() for c in ("exact_jaccard_bucketed", "abs_error")}
    rules |= {c: needed | F.col(c).isNotNull() for c in ("record_a", "record_b")}
    rules |= {c: needed | (F.col(c) >= 0) for c in SIZES}
    _faults(rows, path, rules)
    return rows


def threshold_rows(spark: SparkSession, path: str, k: int = 128, m: int = 64, margin: float = 1e-12) -> DataFrame:
    """Evaluation rows of one dataset, typed; every stated decision and boundary is made again.

    Checked by row: ranges, k and m, tau from the requested threshold, its realised boundary
    within margin, decision, truth and outcomes. Checked over rows: one dataset and variant,
    one identity a pair, and trials 0.. complete and equally many for every pair.
    """
    raw = readers.delimited(spark, path, readers.text_schema(*THRESHOLD_HEADER))
    typed = {c: T.strict_integer(F.col(c)) for c in COUNTS} | {c: T.strict_double(F.col(c)) for c in SHARES} | {c: T.strict_unsigned(F.col(c)) for c in SEEDS}
    rows = raw.select(*[typed.get(c, F.col(c)).alias(c) for c in THRESHOLD_HEADER])
    if rows.isEmpty():
        raise ValueError(f"{path} has no evaluation rows")
    c = F.col
    tau = R.tau_of_jaccard(c("requested_j_threshold"), c("k"), m)
    rules = {name: c(name).isNotNull() for name in typed}
    rules |= {name: c(name).isin(0, 1) for name in ("label", "label_truth", "decision", "exact_j_truth")}
    rules |= {
        "k and m": (c("k") == k) & (c("m") == m),
        "match_count": c("match_count").between(0, k),
        "tau_count": c("tau_count").between(1, k) & (c("tau_count") == tau),
        "trial": c("threshold_trial_index") >= 0,
        "exact_jaccard_bucketed": c("exact_jaccard_bucketed").between(0.0, 1.0),
        "boundary": F.abs(c("realized_j_tau") - R.jaccard_of_tau(tau, c("k"), m)) <= margin,
        "decision": c("decision") == (c("match_count") >= c("tau_count")).cast("bigint"),
        "label_truth": c("label_truth") == c("label"),
        "exact_j_truth": c("exact_j_truth") == (c("exact_jaccard_bucketed") >= c("realized_j_tau")).cast("bigint"),
        "label_outcome": c("label_outcome") == stats.outcome(c("decision") == 1, c("label_truth") == 1),
        "exact_j_outcome": c("exact_j_outcome") == stats.outcome(c("decision") == 1, c("exact_j_truth") == 1),
        "split": c("split") == "evaluation",
    }
    _faults(rows, path, rules)
    names = rows.select("dataset", "variant").distinct().limit(2).collect()
    if len(names) > 1:
        raise ValueError(f"{path} holds several datasets: {names}")
    identity = F.struct("label", "pair_kind", "record_a", "record_b", "rank_position", "exact_jaccard_bucketed")
    V.demand(V.one_to_many(rows.select("pair_id", identity.alias("identity")), "pair_id", "identity"), f"{path}: a pair changes its identity")
    V.demand(V.incomplete(rows, "pair_id", "threshold_trial_index"), f"{path}: a pair's trials have gaps or repeat")
    trials = rows.groupBy("pair_id").count().select("count").distinct().limit(2).collect()
    if len(trials) > 1:
        raise ValueError(f"{path}: pairs have different numbers of trials")
    return rows
