"""The canonical column of op3 is of the rendered transcript, whole or in pieces."""

import random

import pytest

from regionweave.llm import chat

SF = "/root/testdata/sf0.001"
OPENS = [k for k, (_, place) in enumerate(chat.STATES) if not place]


def _transcripts(rows):
    """The lines of every conversation as it is written."""
    by: dict = {}
    for g in sorted(chat._turns(rows).collect(), key=lambda g: (g.conv_id, g.turn)):
        by.setdefault(g.conv_id, []).extend(chat.written(g.role, g.text, g.look, g.shown, g.spaced))
    return {k: "\n".join(v) for k, v in by.items()}


def _digest(text):
    return f"{chat.digest(text)[0]:064x}"


def test_canonical_is_the_digest_of_the_rendering(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    model = chat.fit(rows)
    wanted = {k: _digest(chat.render(model.parse(t))) for k, t in _transcripts(rows).items()}
    assert {r.conv_id: r.canonical for r in chat.format_frame(rows, model).collect()} == wanted


def test_a_conversation_in_several_ranges_is_rendered_as_one(spark):
    r = random.Random(3)
    model = chat.fit(spark.read.parquet(f"{SF}/conversations.parquet"))
    said = lambda: "\n".join(r.choice(["", "", "word " * r.randint(1, 30), "- item", "what?"]) for _ in range(r.randint(1, 5)))
    df = spark.createDataFrame([(7, i, r.choice(["user", "assistant", None]), said()) for i in range(300)], "conv_id long, turn long, role string, text string")
    text = chat.render(model.parse(_transcripts(df)[7]))
    try:
        for n in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert chat.format_frame(df, model).first().canonical == _digest(text)
            rows = chat.turns_frame(df, model).orderBy("part", "nth").collect()
            assert "".join(x.rendered for x in rows) == text and len({x.part for x in rows}) == int(n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", range(40))
def test_pieces_cut_anywhere_are_rendered_as_the_whole(seed):
    r = random.Random(seed)
    lines = [r.choice(["", "", "", "a", "User:", "User: b", "### Assistant:"]) for _ in range(14)]
    states = [OPENS[0]] + [r.choice([*OPENS[:2], None, None, None]) for _ in lines[1:]]
    for i, s in enumerate(states):  # other lines go on with their turn
        states[i] = s if s is not None else min(states[i - 1] + 1, states[i - 1] // chat.PLACES * chat.PLACES + chat.PLACES - 1)
    whole = "".join(chat.rendered_runs(chat.runs_of(lines, states)))
    assert whole == chat.render([t[:2] for t in chat.turns_of(lines, states)])
    cuts = [0, *sorted(r.sample(range(1, len(lines)), 4)), len(lines)]
    out, digests = "", []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        follow = []
        for line, state in zip(lines[b:], states[b:], strict=True):
            if state in OPENS:
                break
            follow.append(line)
        piece = "".join(chat.rendered_runs(chat.runs_of(lines[a:b], states[a:b]), not a, any(follow)))
        own, n = chat.digest(piece)
        out, digests = out + piece, [*digests, (k, f"{own:064x}", n)]
    assert out == whole and chat.digest_of_pieces(digests) == _digest(whole)
