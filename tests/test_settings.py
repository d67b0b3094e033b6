"""Settings against their rules: one case and more for each kind."""

from quirelake.operators import settings as S

CASES = [
    ("retrieval.top_k", "3", None), ("retrieval.top_k", "0", "out of bounds"), ("retrieval.top_k", "2.5", "wrong kind"), ("retrieval.top_k.voice", "-1", "out of bounds"), ("retrieval.top_k", "true", "wrong kind"), ("retrieval.top_k", "oops", "not JSON"), ("retrieval.top_k", None, "not JSON"),
    ("no.such", "1", "unknown key"), ("retrieval.context.ctx_heavy_below_words", "0", None), ("retrieval.expansion.weight", "0", None), ("retrieval.expansion.weight", "-0.5", "out of bounds"), ("generation.connect_timeout_s", "0", "out of bounds"), ("generation.connect_timeout_s", "0.1", None),
    ("dup.jaccard_threshold", "1", None), ("dup.jaccard_threshold", "1.01", "out of bounds"), ("dup.jaccard_threshold", '"1"', "wrong kind"), ("dup.enabled", "false", None), ("dup.enabled", "0", "wrong kind"), ("tts.voice", '" "', "out of bounds"), ("tts.voice", '"x"', None),
    ("generation.fallback_message", '"' + "x" * 201 + '"', "out of bounds"), ("catalog.nouns", '["a"]', None), ("catalog.nouns", "[]", "out of bounds"), ("catalog.nouns", '["a", " "]', "out of bounds"), ("catalog.nouns", "[1]", "wrong kind"), ("catalog.normalize_map", '{"a": ""}', None), ("catalog.normalize_map", '{"a": 1}', "out of bounds"), ("catalog.normalize_map", "{}", "out of bounds"),
    ("retrieval.context.weights_identity", '{"standalone": 0.5, "ctx": 1}', None), ("retrieval.context.weights_identity", '{"standalone": 0, "ctx": 0}', "out of bounds"), ("retrieval.context.weights_identity", '{"other": 1}', "unknown name"), ("retrieval.context.weights_identity", '{"ctx": "1"}', "wrong kind"), ("retrieval.context.weights_identity", '{"ctx": -1}', "out of bounds"),
    ("label.mode", '"off"', None), ("label.mode", '"on"', "unknown name"), ("generation.temperature", "2.1", "out of bounds"), ("generation.top_p", "null", None), ("generation.top_p", "0", "out of bounds"), ("generation.temperature", "null", "wrong kind"), ("stt.eot_timeout_ms", "500", None), ("stt.eot_timeout_ms", "499", "out of bounds"),
]


def test_violations(spark):
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(CASES)], "id int, key string, value string")
    got = {r.id: r.problem for r in S.violations(df, S.rule_table(spark)).collect()}
    assert {i: (*CASES[i][:2], got.get(i)) for i in range(len(CASES))} == dict(enumerate(CASES))
    assert S.violations(df.limit(0), S.rule_table(spark)).count() == 0
