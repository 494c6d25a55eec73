import json

import pytest

from tidemark.llm import replies

EN = "You worked on the parser and the tests are green again. The rest of the day went into the cache."
DE = "Du hast den Parser neu geschrieben und die Prüfungen sind wieder grün. Der Rest des Tages ging in den Speicher."
USER = "DATE: 2026-01-01\n\nFACTS:\n- parser moved behind the cache\n\nTRANSCRIPT SAMPLE (2 turns):\n[you] Please look at the parser once more before we go on.\n[assistant] The tests of the parser are green and nothing else was touched."
TRAIN = [(EN * 5, "en"), (USER * 3, "en"), (DE * 8, "de"), ("Has trabajado en el analizador y las pruebas pasan otra vez. El resto del día fue para la memoria. " * 8, "es"), ("你今天主要在处理解析器，测试又通过了。剩下的时间花在缓存上。" * 8, "zh")]
MODELS = replies.fit(TRAIN, [EN, DE, EN, DE, json.dumps({"narrative": EN})] * 30)


def draft(text, **more):
    return json.dumps({"narrative": text, "highlights": ["a"], "preferences": [], "open_threads": []} | more, ensure_ascii=False)


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        (None, "empty"), ("", "empty"), (" \n​", "empty"), ("N/A", "empty"), ("null", "empty"), ('""', "empty"), ("[]", "empty"), ("{}", "empty"), (draft("", highlights=[]), "empty"), ("```json\n{}\n```", "empty"),
        ("I'm sorry, but I can't help with writing this entry.", "refusal"), (draft("As an assistant I am not able to summarise sessions like this one.", highlights=[]), "refusal"),
        ("Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"), ("No me es posible resumir la sesión, debo rechazar la petición.", "refusal"), ("抱歉，我无法协助完成这个请求。", "refusal"),
        (draft("The service refused the connection twice, and you said you cannot reproduce it without the cache. " + EN), None),
        (USER, "copied_prompt"), ("the tests of the parser are green and nothing else was touched. please look at the parser once more before we go on.", "copied_prompt"),
        (draft(EN)[:90], "truncated"), ("```json\n" + draft(EN)[:120], "truncated"), (draft(EN[:-9]), "truncated"), (EN[:-14], "truncated"),
        (draft(DE), "other_language"), (DE, "other_language"),
        (draft(EN), None), (draft(EN, mood="x"), None), (EN, None), ("```json\n" + draft(EN) + "\n```", None), (json.dumps({"narrative": EN}), None),
    ],
)
def test_defects(raw, expected):
    assert replies.defect(raw, USER, MODELS) == expected


def test_without_a_prompt_a_reply_is_judged_alone():
    assert replies.defect(draft(DE), None, MODELS) is None
    assert replies.defect("", None, MODELS) == "empty"


def test_rows(spark):
    attempts = spark.createDataFrame([(1, 1, ""), (1, 2, draft(EN)), (2, 1, None), (9, 1, "N/A"), (1, 1, "")], "result_id long, attempt_index int, raw string").selectExpr("*", "'x' as user", "true as ok")
    results = spark.createDataFrame([(1, [("system", "s"), ("user", USER)]), (2, []), (None, [("user", "x")])], "result_id long, prompt_messages array<struct<role: string, content: string>>").selectExpr("*", "'y' as raw")
    docs = spark.createDataFrame([(i, t, lang, len(t)) for i, (t, lang) in enumerate(TRAIN)] + [(99, None, None, 0)], "doc_id long, text string, lang string, n_chars int")
    got = sorted(tuple(r) for r in replies.broken_pairs(attempts, results, docs).collect())
    assert got == [(1, 1, "empty"), (1, 1, "empty"), (2, 1, "empty"), (9, 1, "empty")]
    assert replies.broken_pairs(attempts.limit(0), results, docs).count() == 0
    assert replies.broken_pairs(attempts, results.limit(0), docs.limit(0)).count() == 4


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    model = replies.fit(replies.training_texts(docs, per_language=150), [])
    held = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1 and lang is not null and n_chars > 300 and source not in ('config_file', 'log_excerpt')").limit(1500)
    rows = [(r["text"], r["lang"].lower()) for r in held.collect()]
    assert sum(model.posterior(t)[0] == lang for t, lang in rows) / len(rows) > 0.97


@pytest.mark.parametrize("text", ["Sorry, that's not something I can help with.", "I'd rather not do that one.", "Das mache ich nicht.", "No voy a hacer eso.", "我不会做这个。", "I'm afraid I'm not able to write that for you.", "No puedo escribir esta nota.", "这个请求我不能处理。"])
def test_refusals_in_words_that_were_not_learnt(text):
    from tidemark.llm.refusals import DECLINING

    assert text not in DECLINING and replies.defect(text, USER, MODELS) == "refusal"


@pytest.mark.parametrize("text", ["You fixed the parser, which was unable to process empty input files.", "The login request was denied because the token had expired, so you renewed it.", "Der Server hat die Anfrage abgelehnt, du hast sie wiederholt."])
def test_reports_of_failures_are_no_refusals(text):
    assert not replies.refused(text, MODELS.refusals)


def test_every_reply_is_counted(spark):
    rows = [(i, 1, "ab." if i % 2 else "b." + "x" * 30_000) for i in range(60)]
    got = replies.end_counts(spark.createDataFrame(rows, "result_id long, attempt_index int, raw string").repartition(5))
    assert got["ab."] == (30, 30) and got["."] == (60, 30) and got["xxx"] == (30 * 29_998, 30)
