"""Quotation linking by hand-made threads."""

from __future__ import annotations

import re
from random import Random

import pytest

from moveloom.llm import quotes

ROWS = [
    (1, 0, "user", "Hello there friend\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine\n\nAnd you too?"), (1, 2, "user", "> Hello  THERE friend\nother branch"),
    (1, 3, "user", "On Monday X wrote:\n> And you too?\n>> How are you?\nyes"), (1, 4, "a", "plain"), (2, 0, "u", None), (None, 1, "u", "x"), (1, 2, "user", "dup"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_links_and_order(spark):
    got = quotes.chat_rows(spark, spark.createDataFrame(ROWS, SCHEMA))
    by = {(r.conv_id, r.turn, r.message): r for r in got.collect()}
    parents = {(c, t): r.parent_turn for (c, t, _), r in by.items()}
    assert parents[1, 1] == 0 and parents[1, 2] == 0 and parents[1, 3] == 1 and parents[1, 4] == 3 and parents[2, 0] is None and parents[None, 1] is None
    messages = {m for (_, _, m) in by}
    assert "<|user|>\nyes\n" in messages and not any(">" in m.split("|>", 1)[1] for m in messages)


def test_reply_order_is_preorder(spark):
    ordered, names = quotes.reply_order(spark, spark.createDataFrame(ROWS[:5], SCHEMA))
    turns = [r.turn for r in ordered.orderBy("conv_id", names["reply_path"]).collect()]
    assert turns == [0, 1, 3, 4, 2]  # 3 answers 1, the deeper one, before 2 answers 0


def test_deep_branches(spark):
    rows = [(1, 0, "u", "the first message of all")]
    for t in range(1, 40):
        quoted = rows[max(0, t - 2)][3].split("\n")[-1]
        rows.append((1, t, "u", f"> {quoted}\nmessage number {t} here"))
    ordered, names = quotes.reply_order(spark, spark.createDataFrame(rows, SCHEMA))
    got = {r.turn: r for r in ordered.collect()}
    assert all(got[t][names["parent_turn"]] == max(0, t - 2) for t in range(1, 40))
    order = [r.turn for r in ordered.orderBy(names["reply_path"]).collect()]

    def preorder(t):
        children = [c for c in range(t + 1, 40) if got[c][names["parent_turn"]] == t]
        children.sort(key=lambda c: (c != t + 1, c))
        return [t, *(x for c in children for x in preorder(c))]

    assert order == preorder(0)


def random_threads(seed):
    """Conversations whose messages quote earlier ones, whole or in part, at several levels, with lines that announce it."""
    rng, rows = Random(seed), []
    words = ["ja", "no", "peut-être", "MAYBE", "later", "über", "x1", "we  see"]
    for conv in range(6):
        texts, gaps = [], 0
        for turn in range(rng.randint(1, 25)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if texts and rng.random() < 0.7:
                    own = rng.choice(texts).split("\n")
                    at = rng.randrange(len(own))
                    part = own[at : at + rng.randint(1, 3)]
                    if rng.random() < 0.3:
                        lines.append("On Tuesday Bo wrote:")
                    lines += [rng.choice(["> ", ">", " >  "]) + (x.upper() if rng.random() < 0.3 else x) for x in part]
                lines += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 2))]
                if rng.random() < 0.4:
                    lines.append("")
            texts.append("\n".join(lines))
            gaps += rng.randint(1, 3)
            rows.append((conv, gaps, "user", texts[-1]))
    return rows


def linked_by_hand(rows):
    """{(conv, turn): (parent, number of linked passages)} by looking at every earlier message."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        units = []
        for _, _, _, text in own:
            found, run = set(), []
            for line in [*text.split("\n"), ""]:
                marks = re.match(r"^(?:[ \t]*>)+", line)
                level, body = (marks[0].count(">"), line[marks.end() :]) if marks else (0, line)
                body = " ".join(body.lower().split())
                if run and (not body or run[-1][0] != level):
                    found.add((run[0][0], " ".join(b for _, b in run)))
                    run = []
                if body:
                    found.add((level, body))
                    run.append((level, body))
            units.append(found)
        for i, (_, turn, _, _) in enumerate(own):
            links = {}
            for level, body in units[i]:
                sources = [own[j][1] for j in range(i) if (0, body) in units[j]]
                if level and sources:
                    links[level, body] = max(sources)
            best = max(((-level, len(body), source) for (level, body), source in links.items()), default=None)
            out[conv, turn] = (best[2] if best else own[i - 1][1] if i else None, len({body for _, body in links}))
    return out


def order_by_hand(links, conv):
    """Turns in reply order: a chain of direct answers, then the branches that answer its messages, of deeper ones first."""
    turns = sorted(t for c, t in links if c == conv)
    chains, previous = {}, None
    for t in turns:
        head = t if previous is None or links[conv, t][0] != previous else head
        chains.setdefault(head, []).append(t)
        previous = t

    def shown(head):
        branches = sorted((-links[conv, h][0], h) for h in chains if h != turns[0] and links[conv, h][0] in chains[head])
        return [*chains[head], *(t for _, h in branches for t in shown(h))]

    return shown(turns[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_threads_by_hand(spark, monkeypatch, seed):
    monkeypatch.setattr(quotes, "BLOCK_TURNS", 3)
    rows = random_threads(seed)
    want = linked_by_hand(rows)
    ordered, names = quotes.reply_order(spark, spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = ordered.orderBy("conv_id", names["reply_path"]).collect()
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): (r[names["parent_turn"]], r[names["quote_links"]]) for r in got} == want and any(n for _, n in want.values())
    for conv in range(6):
        assert [r.turn for r in got if r.conv_id == conv] == order_by_hand(want, conv)
    assert not any(re.match(r"[ \t]*>", line) for r in got for line in r[names["clean_text"]].split("\n"))


def test_rows_are_neither_lost_nor_doubled(spark):
    long_text = "\n".join(f"line {i} of a very long message" for i in range(5000))
    rows = [*ROWS, ROWS[0], ROWS[5], (3, 1, "user", long_text), (3, 2, "user", "> line 4999 of a very long message\nyes"), (None, None, None, None), (4, None, "x", "y")]
    got = quotes.chat_rows(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and [r.parent_turn for r in got if (r.conv_id, r.turn) == (3, 2)] == [1]


def test_blocks_of_turns_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = sorted(map(str, quotes.chat_rows(spark, df).collect()))
    monkeypatch.setattr(quotes, "BLOCK_TURNS", 2)
    assert sorted(map(str, quotes.chat_rows(spark, df).collect())) == want


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quotes.chat_rows(spark, empty).count() == 0
    clash = spark.createDataFrame([(1, 0, "u", "x", 5)], SCHEMA + ", parent_turn int")
    out, names = quotes.reply_order(spark, clash)
    assert names["parent_turn"] == "_parent_turn" and out.first().parent_turn == 5
