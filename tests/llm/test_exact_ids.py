"""Ids beyond 2**53 stay exact beside null ids, in every operator that carries them through Python."""

from collections import Counter

from quire.llm import (bin_pack, cgk_decontaminate, chat_quotes, license_rules, mixture_packing, page_diff, setsketch_dedup, source_mix,
                       stupid_backoff, token_alignment)

IDS = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63), None, None]
TEXTS = ["the quick brown fox jumps over the lazy dog again and again", "the quick brown fox jumps over the lazy dog again and again",
         "some other text that stands alone in this small corpus", "one more", "", None]


def docs(spark):
    rows = [(i, t, "s", "en") for i, t in zip(IDS, TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1)


def same(ids):
    assert Counter(ids) == Counter(IDS)


def test_ids_of_documents(spark):
    d = docs(spark)
    same(r.doc_id for r in stupid_backoff.backoff_scores(d).collect())
    same(r.doc_id for r in license_rules.scan(d).collect())
    same(r.doc_id for r in bin_pack.pack(d).collect())
    same(r.doc_id for r in token_alignment.align(d).collect())
    assert {r.doc_id for r in mixture_packing.pack(d).collect()} == set(IDS)
    assert {r.doc_id for r in source_mix.mix_documents(d).collect()} <= set(IDS)


def test_ids_of_near_duplicates_and_leaks(spark):
    d = docs(spark)
    got = setsketch_dedup.near_duplicates(d, width=3, percent=85).collect()
    same(r.doc_id for r in got)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {2**53 + 1: 2**53 + 1, 2**53 + 3: 2**53 + 1, 2**63 - 1: 2**63 - 1, -(2**63): -(2**63)}
    items = spark.createDataFrame([(2**53 + 1, TEXTS[0]), (None, TEXTS[2])], "item_id long, text string")
    leaks = {(r.doc_id, r.item_id) for r in cgk_decontaminate.find_leaks(d, items).collect()}
    assert leaks == {(2**53 + 1, 2**53 + 1), (2**53 + 3, 2**53 + 1), (2**63 - 1, None)}


def test_ids_of_pages_and_conversations(spark):
    pages = spark.createDataFrame([(i, f"http://h.example/{k}", f"<p>page {k}</p>") for k, i in enumerate(IDS)], "page_id long, url string, html string")
    same(r.page_id for r in page_diff.main_text(pages.coalesce(1)).collect())
    line = "> a line of more than six words"
    rows = [(2**53 + 1, 2**53 + 1, "u", line[2:]), (2**53 + 1, 2**53 + 3, "u", line), (2**63 - 1, None, "u", line), (None, 5, "u", "x")]
    got = chat_quotes.linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    assert {(r.conv_id, r.turn) for r in got} == {(c, t) for c, t, _, _ in rows}
    reply = {r.turn: (r.reply_to_conv, r.reply_to_turn) for r in got if r.conv_id == 2**53 + 1}
    assert reply == {2**53 + 1: (None, None), 2**53 + 3: (2**53 + 1, 2**53 + 1)}
