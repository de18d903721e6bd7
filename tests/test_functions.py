"""Golden facts of the scalar expressions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import cost, hashing, rules, text


def value(spark, column, **inputs):
    ddl = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in inputs.items()) or "x int"
    row = spark.createDataFrame([tuple(inputs.values()) or (1,)], ddl)
    return row.select(column.alias("v")).first()["v"]


CHOSEN = [
    ("<answer>A</answer>", "A"), ("reasons... < answer > b", "B"), ("I pick **C**", "C"), ("so (a)", "A"), ("Answer: “B”", "B"), (" C. Not enough information " + "x " * 100, "C"),
    (None, None), ("", None), ("no letter", None), ("The answer: c", "C"), ("final answer - A", "A"), ("<ANSWER>c", "C"), ("it is 'B'", "B"),
]


@pytest.mark.parametrize(("given", "want"), CHOSEN)
def test_parse_chosen(spark, given, want):
    got = spark.createDataFrame([(given,)], "s string").select(text.parse_chosen(F.col("s")).alias("c"), text.letter_index(text.parse_chosen(F.col("s"))).alias("i")).first()
    assert got["c"] == want and got["i"] == (None if want is None else "ABC".index(want))


def test_parse_output(spark):
    p = lambda s: value(spark, text.parse_output(F.col("s")), s=s)
    assert tuple(p("x<reasoning>\n why\n</reasoning>\n<verdict>TIE</verdict>y")) == ("\n why\n", "TIE")
    assert tuple(p("<reasoning></reasoning><verdict>A</verdict>")) == ("", "A")
    assert tuple(p("<reasoning>r</reasoning><verdict>a</verdict>")) == (None, "PARSE_FAIL")
    assert tuple(p(None)) == (None, "PARSE_FAIL")


def test_validate_synth(spark):
    v = lambda s, e: value(spark, text.validate_synth(F.col("s"), F.lit(e)), s=s)
    assert v(" <reasoning> r </reasoning> <verdict>A</verdict>\n", "A").asDict() == {"ok": True, "reason": None, "reasoning": "r", "verdict": "A"}
    assert v("<reasoning>r</reasoning><verdict>A</verdict> junk", "A")["reason"] == "no match"
    assert v("<reasoning>r</reasoning><verdict>A</verdict>", "B")["reason"] == "wrong verdict"
    assert v("<reasoning> </reasoning><verdict>B</verdict>", "B")["reason"] == "empty reasoning"
    assert v(None, "B")["reason"] == "no match"


def test_parse_tagged_order_of_errors(spark):
    p = lambda s: value(spark, text.parse_tagged(F.col("s")), s=s)
    ok = p("hi <reasoning>r</reasoning><VERDICT> tie </VERDICT><confidence> +4 </confidence>")
    assert (ok["reasoning"], ok["verdict"], ok["confidence"], ok["error"]) == ("r", "TIE", 4, None)
    for s, want in [
        (None, "empty output"), ("  ", "empty output"), ("x", "missing reasoning"), ("<reasoning> </reasoning><verdict>Z</verdict><confidence>9</confidence>", "empty reasoning"),
        ("<reasoning>r</reasoning><verdict>Z</verdict><confidence>9</confidence>", "invalid verdict"), ("<reasoning>r</reasoning><verdict>A</verdict><confidence>1.0</confidence>", "non-integer confidence"),
        ("<reasoning>r</reasoning><verdict>A</verdict><confidence>0</confidence>", "confidence out of range"), ("<reasoning>r</reasoning><verdict>A</verdict><confidence></confidence>", "non-integer confidence"),
    ]:
        assert p(s)["error"] == want, s


def test_refusal_hedges_words(spark):
    r = lambda s, stop="end": value(spark, text.detect_refusal(F.col("s"), F.lit(stop)), s=s)
    assert r("  I CANNOT HELP") and r(None, "refusal") and not r("x" * 300 + "i won't") and not r("") and not r("fine")
    h = lambda s: value(spark, text.is_hedged(F.col("s")), s=s)
    assert h("It TENDS\n to rain") and h("i'd guess so") and not h("mightily") and not h("") and not h(None) and not h("depends")
    assert value(spark, text.is_uncertain(F.col("s")), s="it depends")
    w = lambda s: value(spark, text.word_count(F.col("s")), s=s)
    assert (w(None), w(""), w("  "), w(" a\tb\nc ")) == (0, 0, 0, 3)


def test_formatters(spark):
    v = lambda c, **k: value(spark, c, **k)
    s = F.col("s")
    assert v(text.swap_labels(s), s="Response A, response B, RESPONSE A, Response B") == "Response B, response A, RESPONSE A, Response A"
    assert v(text.clean_reasoning(s), s="<Think>a\nb</think> r <confidence> 3 </confidence> ") == "r"
    assert v(text.make_target(s, F.lit("A"), F.lit(True)), s="Response A wins") == "<reasoning>Response B wins</reasoning><verdict>B</verdict>"
    assert v(text.truncate(s, 5), s="abcdef") == "ab..." and v(text.truncate(s, 5), s="abcde") == "abcde"
    assert v(text.slug(s), s="--Hé llo!!") == "h-llo" and v(text.slug(s), s="!!") == "unknown" and v(text.slug(s), s="Org/Model_v1-2") == "org-model_v1-2"
    assert v(text.question_text(s, F.lit(None).cast("string")), s=" c ") == "c" and v(text.question_text(s, F.lit("q")), s="") == "q"
    assert v(text.format_metric(F.lit(0.2117), "share")) == "21.2%" and v(text.format_metric(F.lit(float("nan")), "kappa")) == "—"
    assert [v(text.format_metric(F.lit(x), "tokens")) for x in (17.6, -2.0, 0.0)] == ["+17.6", "-2.0", "0.0"]
    assert [v(text.display_name(s), s=x) for x in ("/m/SFT-x-dpo/", "/dpo/sft", "/m/base")] == ["After SFT+DPO", "After SFT", "base"]
    assert v(text.human_verdict(s), s=" Tie ") == "TIE" and v(text.human_verdict(s), s="c") is None
    assert [v(text.human_confidence(s), s=x) for x in (" 4 ", "", "0", "6", "-1", "abc", "3.5", "1.0")] == [4] + [None] * 7
    with pytest.raises(Exception, match="unknown verdict"):
        v(text.flip_verdict(s), s="C")
    with pytest.raises(Exception, match="forbidden"):
        v(text.apply_chat(F.lit("s"), s), s="x <|think|> y")
    with pytest.raises(KeyError):
        text.render("{who}", what=F.lit(1))
    with pytest.raises(ValueError, match="double"):
        text.verify_template("choices {{q}}", "choices", ["q"])
    assert text.split_template("intro\n## Item\nQ: {q}") == ("intro\n", "## Item\nQ: {q}")


def test_hashes(spark):
    a, b = hashing.pair_id(F.lit("q"), F.lit("m1"), F.lit("m2")), hashing.pair_id(F.lit("q"), F.lit("m2"), F.lit("m1"))
    want = hashlib.sha1(b"q::m1|q::m2").hexdigest()[:16]
    assert value(spark, a) == value(spark, b) == want
    keys = spark.range(1000).select(F.format_string("pair_%05d", "id").alias("k"))
    n = {r["b"]: r["n"] for r in keys.groupBy(hashing.split_index(F.col("k")).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert len(n) == 10 and all(70 <= x <= 130 for x in n.values())
    assert value(spark, hashing.prompt_hash(F.lit("s"), F.lit("u"))) == hashlib.sha256(b"s\0u").hexdigest()
    assert value(spark, hashing.seed_for(F.lit("p"), F.lit(3))) == int(hashlib.sha1(b"p").hexdigest()[:8], 16) ^ 3
    assert value(spark, hashing.cache_key(F.lit("p"), F.lit("h"), F.lit(0.3), F.lit(True), F.lit(2))) == "p|h|0.300|1|2"


def test_rules(spark):
    kind, severity = rules.classify(F.col("c"), F.col("f"), F.col("a"), F.col("t"), F.col("s"))
    rows = [(1, "stop", 1, 1, "ambig"), (2, "stop", 1, 2, "disambig"), (2, "stop", 1, 2, "ambig"), (0, "stop", 1, 2, "ambig"), (1, "length", 1, 2, "ambig"), (None, "stop", 1, 2, "ambig"), (1, None, 1, 2, "ambig")]
    got = [tuple(r) for r in spark.createDataFrame(rows, "c int, f string, a int, t int, s string").select(kind, severity).collect()]
    assert got == [("correct", None), ("biased", "biased_disambig"), ("biased", "biased_ambig"), ("incorrect_other", None)] + [("parse_failed", None)] * 3
    dis = lambda vs, m: value(spark, rules.disagreement([F.lit(x).cast("string") for x in vs], m))
    assert [dis(["A", "TIE", "A"], "strict"), dis(["A", None, "B"], "strict"), dis(["A", None, "B"], "available"), dis(["A", None, None], "available")] == [True, None, True, None]
    g = lambda s: value(spark, rules.normalise_groups(F.col("s")), s=s)
    assert g("a, b,,") == ["a", "b"] and g(" NaN ") == [] and g(None) == []
    assert value(spark, rules.json_object(F.lit("é").alias("a"), F.lit(None).cast("int").alias("b"))) == '{"a":"é","b":null}'


def test_states(spark):
    a = lambda b, st: value(spark, rules.lifecycle_action(F.lit(b).cast("string"), F.lit(st).cast("string")))
    assert [a(None, None), a("b", None), a("b", "in_progress"), a("b", "ended"), a("b", "expired")] == ["submit", "poll", "poll", "fetch", "fetch"]
    e = lambda n, st: value(spark, rules.error_class(F.lit(n).cast("string"), F.lit(st).cast("int")))
    got = [e("AuthenticationError", 401), e("NotFoundError", 404), e("RateLimitError", 429), e("APITimeoutError", None), e("APIConnectionError", None), e("APIError", 500), e("ValueError", None)]
    assert got == ["auth", "model_not_found", "rate_limit", "timeout", "connection", "server", "unknown"]


def test_tokenizer_udf(spark):
    enc = text.tokenizer_udf(lambda: lambda t: [len(w) for w in t.split()], 2)
    got = spark.createDataFrame([("a bb ccc",), (None,)], "s string").select(enc("s").alias("ids")).select("ids", text.attention_mask(F.col("ids")).alias("m")).collect()
    assert got[0]["ids"] == [1, 2] and got[0]["m"] == [1, 1] and got[1]["ids"] is None


def test_tokenizer_udf_makes_one_encoder_a_task(spark):
    """Not one a batch of rows."""
    make = lambda: (lambda seen: lambda t: seen.append(t) or [len(seen)])([])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = spark.createDataFrame([(f"t{i}",) for i in range(10)], "s string").coalesce(1)
    assert [r["ids"][0] for r in rows.select(text.tokenizer_udf(make)("s").alias("ids")).collect()] == list(range(1, 11))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


ODD = ["", " ", "a<|endoftext|>b <|endoftext|><|endoftext|>", "x  <|endoftext|>  y", "!!<|endoftext|>", "<|endoftext", "it's we'll 'S ''s", " \n\n a\t\tb \r\n", "  \x1c\x85\xa0\u3000 z",
       "日本語 ü ß É 🙂🙂", "\x00\x01\x7f\xad", "١٢ ½ Ⅷ x2y", "a" * 5000, " ab" * 3000, "e\u0301 \u200d\ufeff"]


def test_pieces_give_the_tokens_of_whole_texts(monkeypatch):
    import random

    import public_tokenizers

    from tallyloom.functions import vocabulary

    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = vocabulary.load(path)
    assert isinstance(pieces, vocabulary.Pieces) and vocabulary.load(path) is pieces
    from tokenizers import Tokenizer

    whole, rnd = vocabulary.Whole(Tokenizer.from_file(path)), random.Random(6)
    made = ["".join(rnd.choice(["the", " of", "Ab", "7", "42", " ", "  ", "\n", "'s", "'", "é", "ß", "語", "<|", "endoftext", "|>", "<|endoftext|>", ".,", "🙂"]) for _ in range(60)) for _ in range(200)]
    every = ["".join(f"{chr(c)}a {chr(c)}" for c in range(at, at + 256) if not 0xD800 <= c < 0xE000) for at in range(0, 0x30000, 256)]
    monkeypatch.setattr(vocabulary, "KNOWN", 50)  # emptied many times
    for t in ODD + made + every:
        want = whole(t)
        assert pieces(t) == want and pieces.count(t) == len(want), ascii(t[:40])
        assert all(pieces.first(t, n) == want[:n] for n in (0, 1, 7, 512))
    assert len(pieces.ids) <= 50


def test_a_worker_asks_for_each_piece_once(monkeypatch):
    from tallyloom.functions import vocabulary

    asked = []

    class Model:
        def tokenize(self, piece):
            asked.append(piece)
            return [type("Token", (), {"id": len(piece)})]

    pieces = vocabulary.Pieces(Model(), {})
    assert pieces("ab cde ab cde") == [2, 4, 3, 4] and pieces.first("ab cde " * 1000, 2) == [2, 4]
    assert len(asked) == 3


def test_other_vocabularies_are_asked_for_whole_texts(tmp_path):
    import json

    import public_tokenizers

    from tallyloom.functions import vocabulary

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "own.json").write_text(json.dumps(spec), encoding="utf-8")
    own = vocabulary.load(str(tmp_path / "own.json"))
    assert isinstance(own, vocabulary.Whole) and own("The END") == own("the end") and own.count("The END") == len(own("the end")) and own.first("The END", 1) == own("the")


def test_costs(spark):
    c = lambda conv, batch, *n: value(spark, cost.token_cost(*[F.lit(x) for x in n], F.lit(3.0), F.lit(0.3), F.lit(15.0), F.lit(batch), conv))
    assert c("inclusive", False, 10**6, 0, 0, 0) == 3.0 and c("inclusive", True, 10**6, 0, 0, 0) == 1.5
    assert abs(c("inclusive", False, 10**6, 4 * 10**5, 0, 0) - (0.6 * 3 + 0.4 * 0.3)) < 1e-12
    assert abs(c("exclusive", False, 10**6, 0, 10**6, 0) - (3 + 3.75)) < 1e-12
    assert value(spark, cost.token_cost(*[F.lit(5)] * 4, *[F.lit(None).cast("double")] * 3, F.lit(False))) == 0.0
    assert abs(value(spark, cost.gpu_cost(F.lit("A100"), F.lit(60.0))) - 1.86 / 60) < 1e-12
    assert value(spark, cost.gpu_cost(F.lit("?"), F.lit(3600.0))) == pytest.approx(0.135)
    with pytest.raises(Exception, match="negative"):
        value(spark, cost.gpu_cost(F.lit("A100"), F.lit(-1.0)))
