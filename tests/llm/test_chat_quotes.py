import random
import textwrap
from collections import defaultdict

from quire.llm import chat_quotes as Q

SCHEMA = "conv_id long, turn long, role string, text string"


def by_key(df):
    return {(r.conv_id, r.turn): r for r in df.collect()}


def test_nested_quotes_link_to_their_messages(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nIt is slow."),
        (1, 1, "assistant", "ann wrote:\n> how do  I SORT?\nUse an index on the column."),
        (1, 2, "user", "On Monday bob wrote:\n> > How do I sort?\n> Use an index on the column.\n\nThat works.\nThanks"),
        (1, 3, "user", ">It is slow.\n> nobody said this"),
        (1, 4, "user", "plain answer"),
        (2, 0, "user", "> Use an index on the column.\nIn another thread. He wrote:"),
        (2, 1, "user", "> Thanks\n> That works.\nShort lines say nothing about other threads."),
    ]
    got = by_key(Q.linked_messages(spark.createDataFrame(rows, SCHEMA)))
    reply = {k: (r.reply_to_conv, r.reply_to_turn, r.depth) for k, r in got.items()}
    assert reply == {(1, 0): (None, None, 0), (1, 1): (1, 0, 1), (1, 2): (1, 1, 2), (1, 3): (1, 0, 1),
                     (1, 4): (None, None, 0), (2, 0): (1, 1, 2), (2, 1): (None, None, 0)}
    assert got[2, 1].quoted == "> Thanks\n> That works." and got[1, 4].quoted == ""
    assert got[1, 1].text == "Use an index on the column." and got[1, 2].text == "That works.\nThanks" and got[1, 3].text == ""
    assert got[2, 0].text == "In another thread. He wrote:"
    assert [got[1, t].position for t in range(5)] == list(range(5))
    assert (got[1, 2].n_quoted, got[1, 2].max_level) == (2, 2)


def test_long_chains_have_their_depth(spark):
    rows = [(7, t, "u", f"line {t}" + (f"\n> line {t - 1}" if t else "")) for t in range(40)]
    got = by_key(Q.linked_messages(spark.createDataFrame(rows, SCHEMA), part_turns=8))
    assert [got[7, t].depth for t in range(40)] == list(range(40))
    assert [got[7, t].position for t in range(40)] == list(range(40))


def test_a_frequent_line_belongs_to_its_first_writer(spark):
    rows = [(c, t, "u", "thanks\n> thanks" if t else "thanks") for c in range(30) for t in range(5)]
    got = by_key(Q.linked_messages(spark.createDataFrame(rows, SCHEMA)))
    assert all((r.reply_to_conv, r.reply_to_turn) == ((c, 0) if t else (None, None)) for (c, t), r in got.items())


def test_nulls_repeats_ties_and_empty_tables(spark):
    rows = [(None, 0, "u", "a line"), (None, None, None, "> a line"), (3, 0, "u", None), (3, 0, "u", None), (3, None, "u", ">"),
            (3, 1, "u", "> > >\n>>> x"), (4, 0, "u", "word " * 200_000)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", lines int, h string")
    out = Q.linked_messages(df).collect()
    assert len(out) == len(rows)
    spots = defaultdict(list)
    for r in out:
        spots[r.conv_id].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in spots.values())
    assert Q.linked_messages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_conversations_without_quotes_stay_as_they_are(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = by_key(Q.linked_messages(rows))
    for r in rows.collect():
        assert got[r.conv_id, r.turn].text == r.text.strip() and got[r.conv_id, r.turn].position == r.turn


def test_rewrapped_and_partial_quotes_equal_brute_force(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(40)) for _ in range(n)).capitalize() + "."
    rows, want, texts = [], {}, {}
    for c in range(12):
        for t in range(5):
            own = "\n\n".join(" ".join(say(rng.randint(4, 25)) for _ in range(4)) for _ in range(2))
            texts[c, t] = own
            quote = ""
            if t:
                to = (c, rng.randrange(t)) if t % 2 or not c else (rng.randrange(c), rng.randrange(5))
                kind = rng.randrange(3)
                part = texts[to].split("\n\n")[rng.randrange(2)]
                if kind == 1:
                    part = part.split(". ")[1] + "."
                if kind == 2:
                    part = " ".join(part.split()[3:15])
                quote = textwrap.fill(part, rng.choice((30, 72)), initial_indent="> ", subsequent_indent="> ") + "\n"
                clean = lambda x: " ".join(x.lower().split())
                holders = sorted(k for k, x in texts.items() if clean(part) in clean(x) and k != (c, t))
                far = [k for k in holders if k[0] < c] if len(part.split()) >= Q.WINDOW else []
                want[c, t] = min([k for k in holders if k[0] == c] or far or [(None, None)])
            rows.append((c, t, "u", quote + own))
    got = by_key(Q.linked_messages(spark.createDataFrame(rows, SCHEMA)))
    assert {k: (got[k].reply_to_conv, got[k].reply_to_turn) for k in want} == want


def test_a_later_turn_of_the_same_conversation_hides_no_other_writer(spark):
    line = "these are some shared words here"
    rows = [(3, 0, "u", f"> {line}\nfirst"), (3, 1, "u", line), (2, 3, "u", line), (4, 0, "u", line.capitalize())]
    got = by_key(Q.linked_messages(spark.createDataFrame(rows, SCHEMA)))
    assert (got[3, 0].reply_to_conv, got[3, 0].reply_to_turn) == (2, 3)


def test_messages_that_quote_each_other_close_no_circle(spark):
    a, b = "one long line of the first thread", "another long line of the second thread"
    got = by_key(Q.linked_messages(spark.createDataFrame([(1, 0, "u", f"> {b}\n{a}"), (2, 0, "u", f"> {a}\n{b}")], SCHEMA)))
    assert {k: (r.reply_to_conv, r.depth) for k, r in got.items()} == {(1, 0): (None, 0), (2, 0): (1, 1)}
    assert got[1, 0].quoted == f"> {b}"
