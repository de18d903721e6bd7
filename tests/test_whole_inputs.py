"""Registered queries read whole texts and all rows: small tables with what a prefix or an id filter would lose."""

import pytest

from tallyloom.plans import catalog


@pytest.fixture
def rows(spark, tmp_path):
    def run(name, **tables):
        for table, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return [r.asDict() for r in catalog.queries()[name](spark, str(tmp_path)).collect()]

    run.folder = str(tmp_path)
    return run


def documents(*texts):
    return [(i, t) for i, t in texts], "doc_id long, text string"


PAD = "word " * 40


def test_hedges_past_the_head(rows):
    got = {r["doc_id"]: (r["hedged"], r["uncertain"]) for r in rows("t8_hedged_uncertain", documents=documents((4, PAD + "it is probably so"), (5, PAD + "hard to say"), (10, PAD)))}
    assert got == {4: (True, True), 5: (False, True), 10: (False, False)}


def test_tags_past_the_head(rows):
    docs = documents((3, PAD + "<reasoning>r</reasoning><verdict>B</verdict>"), (7, "<reasoning>" + PAD + "</reasoning><verdict>A</verdict>"), (8, PAD))
    assert {r["doc_id"]: r["verdict"] for r in rows("t3_parse_output", documents=docs)} == {3: "B", 7: "A", 8: "TIE"}
    assert {r["doc_id"]: (r["ok"], r["reason"]) for r in rows("t4_validate_synth", documents=docs)} == {3: (False, "no match"), 7: (True, None), 8: (True, None)}


def test_refusal_in_the_first_300(rows):
    docs = documents((1, PAD + "I must decline."), (2, PAD + PAD + "I must decline."))
    assert {r["doc_id"]: r["refused"] for r in rows("t6_detect_refusal", documents=docs)} == {1: True, 2: False}


def test_whole_texts_come_out(rows):
    docs = documents((1, PAD + "Response B <confidence>2</confidence> end"))
    assert rows("t13_clean_reasoning", documents=docs)[0]["clean"] == PAD + "Response B  end"
    assert rows("t14_swap_labels", documents=docs)[0]["swapped"] == "Response B, response A: " + PAD + "Response A <confidence>2</confidence> end RESPONSE A"
    assert rows("t25_slug", documents=docs)[0]["slug"] == PAD.replace(" ", "-") + "response-b-confidence-2-confidence-end"


def test_whole_turns(rows):
    question, answer = "q" * 100 + " end?", "a" * 100 + " Response B."
    turns = [(3, 1, "user", question), (3, 2, "assistant", answer)], "conv_id long, turn int, role string, text string"
    got = {r["swap"]: r for r in rows("j22_sft_rows", conversations=turns)}
    assert got[False]["target"] == f"<reasoning>Response A says {answer} but response B does not</reasoning><verdict>B</verdict>"
    assert got[True]["target"] == f"<reasoning>Response B says {answer.replace('B', 'A')} but response A does not</reasoning><verdict>A</verdict>"


def test_patches_of_odd_keys(rows):
    customer = [(k, f"c{k}", 1.0) for k in (1, 2, 3)], "c_custkey long, c_name string, c_acctbal double"
    events = [(1, 1, "click", 5.0, "2024-01-01"), (2, 2, "error", 6.0, "2024-01-01"), (3, 1, "view", 7.0, "2024-01-02"), (4, 9, "view", 8.0, "2024-01-02")], "event_id long, user_id long, event_type string, value double, ts string"
    got = {r["c_custkey"]: (r["c_acctbal"], r["note"]) for r in rows("j9_merge_patches", customer=customer, events=events)}
    assert got == {1: (7.0, "view"), 2: (None, "error"), 3: (1.0, None)}
    assert rows("j9_merge_counts", customer=customer, events=events) == [{"base_rows": 3, "patch_rows": 4, "patched": 2, "unmatched": 1}]


def test_all_pairs_are_checked(spark, rows):
    from tallyloom.plans.analogues import wide

    labels = [(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int"
    docs = [(i, "en", "t", "s", 9) for i in range(40)], "doc_id long, lang string, text string, source string, n_chars long"
    check = rows("j12_cross_check", labels=labels, documents=docs)
    side = rows("j26_side_by_side", labels=labels, documents=docs)
    said = {(r["pair"], r["model"]): (r["plain"], r["swapped"]) for r in wide(spark, rows.folder).collect()}
    assert len(check) == len(side) == 40
    for r in check:
        three = (said[r["pair"], "base"][0], said[r["pair"], "tuned"][0], said[r["pair"], "base"][1])
        assert (r["verdict"], r["verdict_b"], r["verdict_c"]) == three and r["disagreement"] == str(len(set(three)) > 1).lower()
    assert {(r["pair"], r["base"], r["tuned"]) for r in side} == {(i, said[i, "base"][0], said[i, "tuned"][0]) for i in range(40)}
