"""Rules for settings as a table: all settings are checked in one plan, and every violation comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, kind string, low double, high double, open boolean, whole boolean, nullable boolean, options array<string>"
#: How rules are named: (kind, low, high, whether low itself is out, whole numbers only, null allowed, options). Bounds of lists and strings are those of their texts.
KINDS = {
    "positive whole number": ("number", 0.0, None, True, True, False, None),
    "whole number from 0": ("number", 0.0, None, False, True, False, None),
    "number from 0": ("number", 0.0, None, False, False, False, None),
    "number above 0": ("number", 0.0, None, True, False, False, None),
    "number from 0 to 1": ("number", 0.0, 1.0, False, False, False, None),
    "yes or no": ("boolean", None, None, False, False, False, None),
    "text": ("string", 1.0, None, False, False, False, None),
    "line of 200": ("string", 1.0, 200.0, False, False, False, None),
    "list of texts": ("list", 1.0, None, False, False, False, None),
    "map of texts": ("map", None, None, False, False, False, None),
    "weights": ("weights", None, None, False, False, False, ["standalone", "ctx"]),
    "label mode": ("choice", None, None, False, False, False, ["deviation", "always", "off"]),
    "temperature": ("number", 0.0, 2.0, False, False, False, None),
    "top share or null": ("number", 0.01, 1.0, False, False, True, None),
    "wait or null": ("number", 500.0, 60000.0, False, True, True, None),
}
#: What each setting has to be.
RULES = {
    "positive whole number": ("retrieval.top_k", "retrieval.candidate_n", "retrieval.rrf_k", "conversation.history_messages", "conversation.history_max_chars", "retrieval.context.max_words_followup", "retrieval.context.prior_user_turns", "prompts.max_chars", "retrieval.context.identity_max_words", "retrieval.context.affirmation_candidate_n", "retrieval.advisory.max_chunks_per_doc", "source.max_words", "lookup.history_messages", "catalog.max_words", "retrieval.expansion.candidate_n"),
    "whole number from 0": ("retrieval.context.ctx_heavy_below_words", "generation.max_retries.text", "generation.max_retries.voice"),
    "number from 0": ("retrieval.context.weight_standalone", "retrieval.context.weight_ctx", "retrieval.context.affirmation_user_weight", "retrieval.expansion.weight"),
    "number above 0": ("generation.first_token_timeout_s", "generation.request_timeout_s", "generation.connect_timeout_s", "generation.stream_gap_timeout_s", "generation.keepalive_expiry_s"),
    "number from 0 to 1": ("label.norm_min_share", "dup.jaccard_threshold", "dup.containment_threshold", "generation.confidence_threshold"),
    "yes or no": ("retrieval.context.dual_query.enabled", "dup.enabled", "dup.title_match", "catalog.enabled", "retrieval.expansion.enabled", "generation.client_warmup"),
    "text": ("generation.model", "stt.model", "tts.voice", "tts.greeting"),
    "line of 200": ("generation.fallback_message",),
    "list of texts": ("retrieval.context.followup_markers", "retrieval.advisory.markers", "retrieval.context.identity_markers", "smalltalk.affirmations", "smalltalk.offer_markers", "source.markers", "section.markers", "page.markers", "lookup.wh_words", "lookup.anaphors", "title.generic_phrases", "catalog.vocab", "catalog.nouns"),
    "map of texts": ("catalog.normalize_map",),
    "weights": ("retrieval.context.weights_identity", "retrieval.context.weights_with_marker", "retrieval.context.weights_without_marker"),
    "label mode": ("label.mode",),
    "temperature": ("generation.temperature",),
    "top share or null": ("generation.top_p",),
    "wait or null": ("stt.eot_timeout_ms",),
}


def rule_table(spark: SparkSession, rules: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    return spark.createDataFrame([(key, *KINDS[name]) for name, keys in (rules or RULES).items() for key in keys], SCHEMA)


def violations(settings: DataFrame, rules: DataFrame, channels: tuple[str, ...] = ("text", "voice")) -> DataFrame:
    """(settings' columns, problem) of settings (key, value: JSON text) that break their rule; a key with a channel behind falls under its own rule or that of the
    key without. Rules are a small table. Problems: unknown key, not JSON, wrong kind, out of bounds, unknown name. Null values are not JSON."""
    bare = F.regexp_replace("key", rf"\.(?:{'|'.join(channels)})$", "")
    own = rules.select(F.struct("*").alias("own"), F.col("key").alias("k1"))
    general = rules.select(F.struct("*").alias("general"), F.col("key").alias("k2"))
    rows = settings.join(F.broadcast(own), settings["key"] == F.col("k1"), "left").withColumn("bare", bare).join(F.broadcast(general), F.col("bare") == F.col("k2"), "left")
    rows = rows.select(*[settings[c] for c in settings.columns], F.coalesce("own", "general").alias("r"), F.try_parse_json("value").alias("v"))
    shape, r, v = F.schema_of_variant("v"), F.col("r"), F.col("v")
    n = F.try_variant_get(v, "$", "double")
    inside = lambda x: ~F.coalesce((x < r["low"]) | (r["open"] & (x <= r["low"])) | (x > r["high"]), F.lit(False))
    number = F.when(~shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") | (r["whole"] & (shape != "BIGINT")), "wrong kind").when(~inside(n), "out of bounds")
    text = F.try_variant_get(v, "$", "string")
    long = F.char_length(F.trim(text))
    string = F.when(shape != "STRING", "wrong kind").when(~inside(long), "out of bounds")
    items = F.try_variant_get(v, "$", "array<string>")
    listed = F.when(~shape.rlike("^ARRAY<(STRING|VOID)>$"), "wrong kind").when((F.size(items) == 0) | F.exists(items, lambda x: x.isNull() | (F.trim(x) == "")), "out of bounds")
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    texts = F.try_variant_get(v, "$", "map<string,string>")
    mapped = F.when(~shape.startswith("OBJECT"), "wrong kind").when((F.size(keys) == 0) | F.exists(keys, lambda k: F.trim(k) == "") | shape.contains(": BIGINT") | shape.contains(": BOOLEAN") | texts.isNull(), "out of bounds")
    parts = F.map_values(F.try_variant_get(v, "$", "map<string,double>"))
    weights = F.when(~shape.startswith("OBJECT") | shape.contains("STRING") | shape.contains("BOOLEAN") | shape.contains("VOID"), "wrong kind").when((F.size(keys) == 0) | (F.size(F.array_except(keys, r["options"])) > 0), "unknown name").when(F.exists(parts, lambda x: x < 0) | ((F.size(parts) == 2) & F.forall(parts, lambda x: x == 0)), "out of bounds")
    choice = F.when(shape != "STRING", "wrong kind").when(~F.array_contains(r["options"], text), "unknown name")
    kinds = {"number": number, "boolean": F.when(shape != "BOOLEAN", "wrong kind"), "string": string, "list": listed, "map": mapped, "weights": weights, "choice": choice}
    found = F.when(r.isNull(), "unknown key").when(v.isNull(), "not JSON").when(r["nullable"] & (shape == "VOID"), None)
    for kind, problem in kinds.items():
        found = found.when(r["kind"] == kind, problem)
    return rows.select(*settings.columns, found.alias("problem")).filter("problem IS NOT NULL")
