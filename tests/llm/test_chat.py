import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tabulith.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string, tokens string, place int"
TOKEN = re.compile(chat.TOKEN)


@pytest.fixture(scope="session")
def turns(spark):
    return lambda rows: spark.createDataFrame([(*r, "w", "t", 1) for r in rows], SCHEMA)


def escape(text):
    return re.sub(r"<(?=/?turn)", r"<\\", text.replace("\\", "\\\\"))


def by_hand(conv, budget, history, segment):
    """Windows of one conversation as (first, last, tokens, text), one turn after another."""
    conv = sorted(((t if t is not None else -10**9), r or "", x or "") for t, r, x in conv)
    size = [chat.MARKS + len(TOKEN.findall(x)) for _, _, x in conv]
    before = [sum(size[:i]) for i in range(len(conv))]
    say = lambda i: f"<turn>{escape(conv[i][1])}<turn:>{escape(conv[i][2])}</turn>\n"
    lead = [0] if conv[0][1] == "system" else []
    room = budget - sum(size[i] for i in lead)
    i, out = len(lead), []
    while i < len(conv):
        left = max(0, min(history, room - size[i]))
        shown = i
        while shown > len(lead) and before[i] - before[shown - 1] <= left:
            shown -= 1
        end = i + 1
        while end < len(conv) and before[end] // (segment * budget) == before[i] // (segment * budget) and \
                before[end] + size[end] - before[shown] <= room:
            end += 1
        rows = lead + list(range(shown, end))
        out.append((0 if lead and i == 1 else i, end - 1, sum(size[k] for k in rows), "".join(map(say, rows))))
        i = end
    return out or [(0, 0, size[0], say(0))]


def random_turns(rng, n):
    words = ["so", "many", "<turn>", "</turn>", "\\", "\\<turn:>", "é", "٣", "\n", "<", "turn", "5", "\U0001f600"]
    roles = ["user", "assistant", "system", "tool <turn:> x\n", None]
    rows = [(t, rng.choice(roles), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 80])))) for t in range(n)]
    return [(t, "system" if t == 0 and rng.random() < 0.5 else r, x) for t, r, x in rows]


@pytest.mark.parametrize("budget, history", [(40, 12), (100, 100), (200, 0)])
def test_windows_as_by_hand(turns, budget, history, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)
    rng = random.Random(budget)
    convs = {c: random_turns(rng, rng.choice([1, 2, 5, 60])) for c in range(12)}
    rows = [(c, *t) for c, conv in convs.items() for t in conv]
    rng.shuffle(rows)
    got = chat.windows(turns(rows), budget, history).collect()
    want = {(c, *w) for c, conv in convs.items() for w in by_hand(conv, budget, history, 3)}
    assert {(r.conv_id, r["first"], r.last, r.tokens, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.over_budget == (r.tokens > budget) for r in got)
    # only a first new turn that does not fit beside the system turn goes beyond the budget
    assert all(not r.over_budget or sum(not t.repeated for t in r.turns) <= 1 + (r["first"] == 0) for r in got)


def test_round_trip_and_loss(turns):
    rng = random.Random(5)
    convs = {c: random_turns(rng, 25) for c in range(8)}
    formatted = chat.windows(turns([(c, *t) for c, conv in convs.items() for t in conv]), 60, 20)
    for r in chat._digests(formatted).collect():
        said = [(role or "", text) for _, role, text in convs[r.conv_id]]
        learned = "".join(x for role, x in said if role == "assistant")
        assert r.n_turns == 25 and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    # a control string stands in the output only where the template put it
    for r in formatted.collect():
        assert len(re.findall("</?turn:?>", r.text)) == 3 * len(r.turns)


def test_odd_rows(turns, rows):
    odd = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, None, None), (1, 2, "assistant", ""),
           (2, 0, "system", "only"), (3, 5, "user", "same"), (3, 5, "user", "same"), (3, 5, "assistant", "tie"),
           (4, 0, "user", "w " * 5000)]
    got = {r.conv_id: r for r in chat._digests(chat.windows(turns(odd))).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {None: 2, 1: 2, 2: 1, 3: 3, 4: 1}
    assert {c: r.loss_chars for c, r in got.items()} == {None: 1, 1: 0, 2: 0, 3: 3, 4: 0}
    long = [r for r in chat.windows(turns(odd)).collect() if r.conv_id == 4]
    assert [r.over_budget for r in long] == [True]
    empty = chat.windows(turns(odd).limit(0))
    assert empty.collect() == [] and chat._digests(empty).collect() == []


def test_own_token_counts(turns):
    conv = [(1, t, "user", "x") for t in range(6)]
    got = chat.windows(turns(conv), 30, 0, tokens=F.lit(10)).collect()
    assert sorted((r["first"], r.last) for r in got) == [(0, 1), (2, 3), (4, 5)]


def test_no_python_on_the_main_path(turns):
    plan = chat.windows(turns([(1, 0, "user", "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("ExistingRDD", ""))
