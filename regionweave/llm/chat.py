"""Chat formatting: roles of a raw transcript's lines by a hidden Markov model, then canonical turns.

A transcript is lines; a line may open with a speaker marker in one of several looks, and markers may be missing or mixed. States are the roles, each with the line's place in its turn (first, second, third, later), so that a role's usual number of lines counts. A line shows its marker (of one of the roles, or none) and features: its length, whether it asks, lists or is blank, and whether a blank line stands before it. Probabilities are counted, with one added, on transcripts of known roles that are not held out. Viterbi gives the likeliest states; a turn starts at every first-line state. Rendering writes each turn as an opening mark, its text without the marker, and a closing mark.

The table's turns are written as transcripts first: one look a conversation, another now and then, every fifth marker left out, a blank line between turns in every second conversation. What the model gives back is held against the turns.

A conversation of any length is one transcript. Rows are dealt in order to ranges, so a long conversation lies in several; its pieces are joined exactly: each gives the best scores between its ends as a max-plus matrix, the matrices of a conversation are chained (a row per range), and each piece is then traced between the states that the chain gives it. A turn that goes on in the next range is closed where its last line that is not blank stands, so the rendered pieces in order are the rendering of the whole.

Rows without conv_id are transcripts of their own. A null role is shown without a marker and is recovered; null text counts as empty; turns with equal numbers are ordered by role and text; an unknown role's name is shown as it is and read as text. An empty table gives no rows; without rows of known roles all probabilities are even. Other columns of any name are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, groups_of, partitions, table
from .learning import held_out

ROLES = ("system", "user", "assistant")
#: Places of a line in its turn that are told apart; the last stands for all later ones.
PLACES = 4
STATES = [(r, p) for r in ROLES for p in range(PLACES)]
#: Names that speakers go by, in lower case.
NAMES = {"system": "system", "instructions": "system", "user": "user", "human": "user", "q": "user", "question": "user", "customer": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant", "model": "assistant", "agent": "assistant"}
#: How a marker may look: "Name:", "### Name:", "[Name]", "<|name|>", "**Name:**".
MARKER = re.compile(r"\s*(?:\*\*(?P<a>[A-Za-z]+):\*\*|###\s*(?P<b>[A-Za-z]+):?(?=\s|$)|\[(?P<c>[A-Za-z]+)\]|<\|(?P<d>[A-Za-z]+)\|>|(?P<e>[A-Za-z]+):(?=\s|$))[ \t]?")
STYLES = ("{Name}: {text}", "### {Name}:\n{text}", "[{Name}] {text}", "<|{name}|>\n{text}", "**{Name}:** {text}")
#: Conversations to count probabilities on, at most, none of more than SAMPLE_TURNS rows.
SAMPLE, SAMPLE_TURNS = 1000, 256
SIZES = (0, 1, 20, 45, 80, 130, 200, 320, 500)
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"
#: A prime; the digest of a text is its bytes as one number, modulo this, so digests of pieces give that of the whole.
MODULUS = (1 << 255) - 19
_LISTED = re.compile(r"(?:[-*•] |\d+[.)] |```|    )")
FEATURES = len(SIZES) * 3 * 2


def marked(line: str) -> tuple[str | None, str]:
    """The role that a line's marker names, and the line without it."""
    m = MARKER.match(line)
    role = NAMES.get(next(g for g in m.groups() if g).lower()) if m else None
    return (role, line[m.end() :]) if role else (None, line)


def observe(line: str, after_blank: bool = False) -> tuple[int, int]:
    """What a line shows: its marker (0 none, else 1 + the role) and the number of its feature class."""
    role, body = marked(line)
    body = body.strip()
    size = sum(len(body) >= s for s in SIZES) - 1
    kind = 2 if _LISTED.match(line) else 1 if body.endswith("?") else 0
    return (0 if role is None else 1 + ROLES.index(role)), (size * 3 + kind) * 2 + after_blank


def observed(lines: list[str], before: str = "x") -> list[tuple[int, int]]:
    """What the lines show; `before` is the line ahead of them."""
    return [observe(x, not p.strip()) for p, x in zip([before, *lines], lines, strict=False)]


class Model:
    """Log-probabilities of first states, transitions and observations."""

    def __init__(self, examples):
        """`examples`: lists of (state number, marker, feature class) per transcript."""
        s = len(STATES)
        start, move, mark, feature = np.ones(s), np.ones((s, s)), np.ones((s, 1 + len(ROLES))), np.ones((s, FEATURES))
        for rows in examples:
            for i, (state, m, f) in enumerate(rows):
                mark[state, m] += 1
                feature[state, f] += 1
                if i:
                    move[rows[i - 1][0], state] += 1
                else:
                    start[state] += 1
        for k, (role, place) in enumerate(STATES):
            if place:  # a turn's further line follows a line of the same role, one place ahead
                start[k] = 0
                for j, (other, ahead) in enumerate(STATES):
                    move[j, k] *= other == role and min(ahead + 1, PLACES - 1) == place
        with np.errstate(divide="ignore"):
            self.start, self.move = np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True))
            self.mark, self.feature = np.log(mark / mark.sum(1, keepdims=True)), np.log(feature / feature.sum(1, keepdims=True))

    def scores(self, seen: list[tuple[int, int]]) -> np.ndarray:
        """Log-probabilities of what every line shows, by state."""
        m, f = np.array(seen, np.int64).reshape(-1, 2).T
        return (self.mark[:, m] + self.feature[:, f]).T

    def viterbi(self, seen: list[tuple[int, int]], entry: int | None = None, leave: int | None = None) -> list[int]:
        """The likeliest states of a run of observations; the lowest state number among equals. `entry` is the state of the line ahead of the run, `leave` that of its last line, where they are given."""
        if not seen:
            return []
        own, move = self.scores(seen), self.move
        score, back = (self.start if entry is None else move[entry]) + own[0], np.zeros((len(seen), len(STATES)), np.int8)
        for i in range(1, len(seen)):
            paths = score[:, None] + move
            back[i] = paths.argmax(0)
            score = paths.max(0) + own[i]
        states = [int(score.argmax()) if leave is None else leave]
        for i in range(len(seen) - 1, 0, -1):
            states.append(int(back[i, states[-1]]))
        return states[::-1]

    def chain(self, seen: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Best scores of a run that opens a transcript, by last state, and of one that goes on, by the state ahead of it and its last state."""
        own = self.scores(seen)
        first, on = self.start + own[0], self.move + own[0]
        for row in own[1:]:
            first = (first[:, None] + self.move).max(0) + row
            on = (on[:, :, None] + self.move[None]).max(1) + row
        return first, on

    def parse(self, transcript: str | None) -> list[tuple[str, str]]:
        """(role, text) of every turn of a transcript, in order; none for null or empty."""
        if not transcript:
            return []
        lines = transcript.split("\n")
        return [(role, text) for role, text, _ in turns_of(lines, self.viterbi(observed(lines)))]


def runs_of(lines: list[str], states: list[int]) -> list[tuple[str, list[str], bool]]:
    """Turns (role, lines without the marker, whether its first line is among them) of lines with their states."""
    turns: list[tuple[str, list[str], bool]] = []
    for line, state in zip(lines, states, strict=True):
        role, place = STATES[state]
        said, rest = marked(line)
        if not place or not turns:
            turns.append((role, [rest] if said and not place else [line], not place))
        else:
            turns[-1][1].append(line)
    return turns


def body(lines: list[str], opens: bool) -> str:
    """Lines of a turn as text; a marker on a line of its own leaves an empty first line."""
    return "\n".join(lines[1:] if opens and len(lines) > 1 and not lines[0] else lines)


def turns_of(lines: list[str], states: list[int]) -> list[tuple[str, str, bool]]:
    """Turns (role, text, whether its first line is among the lines) of lines with their states. Blank lines at a turn's end part turns and are not of its text."""
    return [(role, body(own, opens).rstrip("\n"), opens) for role, own, opens in runs_of(lines, states)]


def render(turns: list[tuple[str, str]]) -> str:
    """Turns in canonical form."""
    return "".join(OPEN.format(role=role) + text + CLOSE for role, text in turns)


def rendered_runs(runs: list[tuple[str, list[str], bool]], first: bool = True, more: bool = False) -> list[str]:
    """The rendering of a piece's turns; pieces in order make up the rendering of the transcript. `first`: the piece opens the transcript; `more`: lines of its last turn that are not blank follow in later pieces."""
    out = []
    for k, (role, lines, opens) in enumerate(runs):
        starts, goes_on = opens or (first and not k), more and k == len(runs) - 1
        text = body(lines, opens)
        if goes_on:
            # an empty first line is dropped, as it is where its turn is whole
            text = "" if opens and lines == [""] else text + "\n"
        elif starts or any(lines):
            text = text.rstrip("\n") + CLOSE
        else:
            text = ""  # blank lines of a turn that is closed in an earlier piece
        out.append(OPEN.format(role=role) * starts + text)
    return out


def digest(text: str) -> tuple[int, int]:
    """A text's digest and its number of bytes."""
    data = text.encode("utf-8", "surrogatepass")
    return int.from_bytes(data, "big") % MODULUS, len(data)


def digest_of_pieces(pieces) -> str:
    """The digest, in hexadecimal, of a text from those of its pieces (part, digest in hexadecimal, bytes) in order."""
    out = 0
    for _, own, n in pieces:
        out = (out * pow(256, n, MODULUS) + int(own, 16)) % MODULUS
    return f"{out:064x}"


def raw(turns: list[tuple[str | None, str]], style: str, between: str = "\n") -> str:
    """A transcript of turns with markers in one style; a turn without a role has no marker."""
    return between.join(style.format(name=r, Name=r.capitalize(), text=t) if r else t for r, t in turns)


def written(role: str | None, text: str, look: int, shown: bool, spaced: bool) -> list[str]:
    """The lines of one turn in a transcript."""
    lines = raw([(role if shown else None, text)], STYLES[look]).split("\n")
    return [*lines, ""] if spaced else lines


def states_of(role: str, n: int) -> list[int]:
    """The states of a turn of `n` lines."""
    first = ROLES.index(role) * PLACES
    return [first + min(i, PLACES - 1) for i in range(n)]


def _turns(rows: DataFrame) -> DataFrame:
    """Turns with how they are written: name (the transcript), conv_id, turn, role, text, look, shown, spaced."""
    at = F.xxhash64("conv_id", "turn", "role")
    name = F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id()))
    look = (F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))) + F.when(F.pmod(at, F.lit(7)) == 0, 1).otherwise(0)) % len(STYLES)
    shown = F.col("role").isNotNull() & (F.pmod(F.shiftright(at, 8), F.lit(5)) != 0)
    spaced = F.pmod(F.shiftright(F.xxhash64("conv_id"), 8), F.lit(2)) == 0
    return rows.select(name.alias("name"), F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"), look.cast("int").alias("look"), shown.alias("shown"), spaced.alias("spaced"))


def fit(rows: DataFrame) -> Model:
    """Counts on at most SAMPLE conversations that are not held out, chosen by a hash of conv_id."""
    known = _turns(rows).filter(F.col("conv_id").isNotNull() & F.col("role").isin(*ROLES) & ~held_out(F.col("conv_id")))
    chosen = known.groupBy(F.col("conv_id").alias("c_")).agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") <= SAMPLE_TURNS)
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("c_"), "c_").limit(SAMPLE).select("c_"))
    held = known.join(chosen, F.col("conv_id") == F.col("c_")).select("conv_id", "turn", "role", "text", "look", "shown", "spaced")
    by: dict = {}
    for r in sorted(held.toLocalIterator(), key=lambda r: (r[0], r[1] or 0, *r[2:])):
        by.setdefault(r[0], []).append(r[2:])
    examples = []
    for turns in by.values():
        lines, states = [], []
        for role, text, look, shown, spaced in turns:
            own = written(role, text, look, shown, spaced)
            lines += own
            states += states_of(role, len(own))
        examples.append([(s, *o) for s, o in zip(states, observed(lines), strict=True)])
    return Model(examples)


def _pieces(batches):
    """Every run of a transcript's turns: (name, part, given turns, their lines, the lines' numbers at which turns open)."""
    for group in groups_of(batches, 1):
        name, part, conv = (group.column(k)[0].as_py() for k in (0, 1, 2))
        given = list(zip(*(group.column(k).to_pylist() for k in range(4, 9)), strict=True))  # role, text, look, shown, spaced
        lines, opens = [], []
        for g in given:
            opens.append(len(lines))
            lines += written(*g)
        yield name, part, conv, given, lines, opens


def _ends(model: Model):
    """Of the first and the last piece of a range, which alone may go on elsewhere: their chains and their number of lines."""

    def ends(batches):
        held = None
        for i, piece in enumerate(_pieces(batches)):
            if not i:
                yield told(piece)
            else:
                held = piece
        if held is not None:
            yield told(held)

    def told(piece):
        name, part, _, _, lines, _ = piece
        first, on = model.chain(observed(lines))
        _, on_blank = model.chain(observed(lines, ""))
        columns = [[name], [part], [len(lines)], [not lines[-1].strip()], [first.tolist()], [on.ravel().tolist()], [on_blank.ravel().tolist()]]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), *[pa.list_(pa.float64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "part", "n", "blank", "first", "on", "on_blank"])

    return ends


def _chained(group: pd.DataFrame) -> pd.DataFrame:
    """A transcript's pieces, in order, with the states around them and the lines ahead of them."""
    group = group.sort_values("part")
    score, back = np.array(group["first"].iloc[0]), []
    after = [False, *group["blank"].iloc[:-1]]  # whether the line ahead of a piece is blank
    for on, on_blank, blank in list(zip(group["on"], group["on_blank"], after, strict=True))[1:]:
        paths = score[:, None] + np.array(on_blank if blank else on).reshape(len(score), -1)
        back.append(paths.argmax(0))
        score = paths.max(0)
    leave = [int(score.argmax())]
    for b in reversed(back):
        leave.append(int(b[leave[-1]]))
    leave = leave[::-1]
    ahead = np.concatenate([[0], np.cumsum(group["n"])[:-1]]).astype(np.int64)
    return pd.DataFrame({"name": group["name"].to_numpy(), "part": group["part"].to_numpy(), "entry": [-1, *leave[:-1]], "leave": leave, "ahead": ahead, "after": after})


def _states(model: Model, around: dict, name: str, part: int, lines: list[str]) -> list[int]:
    """The states of a piece's lines."""
    entry, leave, _, after, _ = around.get((name, part), ALONE)
    return model.viterbi(observed(lines, "" if after else "x"), None if entry < 0 else entry, leave)


def _rendered(around: dict, name: str, part: int, runs: list) -> list[str]:
    entry, *_, more = around.get((name, part), ALONE)
    return rendered_runs(runs, entry < 0, more)


def _heads(model: Model, around: dict):
    """Of the pieces of `around`: whether their first line opens a turn, whether any line does, and whether a line ahead of it is not blank."""

    def heads(batches):
        for name, part, _, _, lines, _ in _pieces(batches):
            if (name, part) in around:
                runs = runs_of(lines, _states(model, around, name, part, lines))
                columns = [[name], [part], [runs[0][2]], [any(r[2] for r in runs)], [not runs[0][2] and any(runs[0][1])]]
                kinds = [pa.string(), pa.int32(), *[pa.bool_()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "part", "opens", "any", "head"])

    return heads


def dealt(rows: DataFrame) -> DataFrame:
    """Turns in order over ranges, kept: name, part, conv_id, turn, role, text, look, shown, spaced. Equal turns of one conversation may lie in several ranges."""
    order = ["name", "turn", "role", "text", "row_"]
    turns = _turns(rows).withColumn("row_", F.monotonically_increasing_id())
    ranged = turns.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return durable(ranged.select("name", F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "look", "shown", "spaced"))


#: What `around_pieces` says of a piece that is a whole transcript.
ALONE = (-1, None, 0, False, False)


def around_pieces(turns: DataFrame, model: Model) -> dict:
    """(entry state, last state, lines ahead, whether a blank line is ahead, whether later pieces go on with the last turn) of the pieces at the ends of ranges, by (name, part): two a range at most, so their number is bounded by the session's partitions."""
    ends = turns.mapInArrow(_ends(model), "name string, part int, n long, blank boolean, first array<double>, on array<double>, on_blank array<double>")
    chained = ends.groupBy("name").applyInPandas(_chained, "name string, part int, entry int, leave int, ahead long, after boolean")
    ends = {(r[0], r[1]): (*r[2:], False) for r in chained.collect()}
    parts: dict[str, list[int]] = {}
    for name, part in sorted(ends):
        parts.setdefault(name, []).append(part)
    cut = {k: v for k, v in ends.items() if len(parts[k[0]]) > 1}
    heads = {(r[0], r[1]): r[2:] for r in turns.mapInArrow(_heads(model, cut), "name string, part int, opens boolean, any boolean, head boolean").collect()} if cut else {}
    for name, own in parts.items():
        more = False
        for ahead, part in reversed(list(zip(own, own[1:], strict=False))):
            opens, some, head = heads[name, part]
            more = not opens and (head or (not some and more))
            ends[name, ahead] = (*ends[name, ahead][:-1], more)
    return ends


def format_frame(rows: DataFrame, model: Model) -> DataFrame:
    """Per transcript: conv_id, held_out, n_turns given, n_lines, n_found turns, n_hidden (turns of known role written without a marker), n_recovered (of these, opened by the model with the right role), n_agree (the same of all turns of known role), canonical (the digest of the rendered transcript, see MODULUS)."""
    turns = dealt(rows)
    around = rows.sparkSession.sparkContext.broadcast(around_pieces(turns, model))

    def work(batches):
        out = []
        for name, part, conv, given, lines, opens in _pieces(batches):
            states = _states(model, around.value, name, part, lines)
            right = [g[0] in ROLES and STATES[states[at]] == (g[0], 0) for g, at in zip(given, opens, strict=True)]
            hidden = [g[0] in ROLES and not g[3] for g in given]
            own, n = digest("".join(_rendered(around.value, name, part, runs_of(lines, states))))
            out.append((name, conv, len(given), len(lines), sum(STATES[s][1] == 0 for s in states), sum(hidden), sum(h and r for h, r in zip(hidden, right, strict=True)), sum(right), part, f"{own:064x}", n))
            if len(out) == 1000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        kinds = [pa.string(), *[pa.int64()] * 8, pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*names, "part", "digest", "bytes"])

    names = ["name", "conv_id", "n_turns", "n_lines", "n_found", "n_hidden", "n_recovered", "n_agree"]
    told = turns.mapInArrow(work, ", ".join(["name string", *[f"{n} long" for n in names[1:]], "part long", "digest string", "bytes long"]))
    sums = [F.sum(n).alias(n) for n in names[2:]]
    pieces = F.array_sort(F.collect_list(F.struct("part", "digest", "bytes")))  # one a range at most
    both = told.groupBy("name", "conv_id").agg(*sums, pieces.alias("pieces"))
    whole = F.when(F.size("pieces") == 1, F.get("pieces", F.lit(0))["digest"]).otherwise(F.udf(digest_of_pieces, "string")("pieces"))
    return both.select("conv_id", held_out(F.col("conv_id")).alias("held_out"), *names[2:], whole.alias("canonical"))


def turns_frame(rows: DataFrame, model: Model) -> DataFrame:
    """The canonical turns themselves, in order within each range: conv_id, part, nth (from 0 in the piece), role, opens (false for the rest of a turn that began in the range before), text, rendered (all rows of a conversation in order make up its canonical text)."""
    turns = dealt(rows)
    around = rows.sparkSession.sparkContext.broadcast(around_pieces(turns, model))

    def work(batches):
        for name, part, conv, _, lines, _ in _pieces(batches):
            states = _states(model, around.value, name, part, lines)
            found = turns_of(lines, states)
            columns = [[conv] * len(found), [part] * len(found), list(range(len(found))), [r for r, _, _ in found], [o for *_, o in found], [t for _, t, _ in found], _rendered(around.value, name, part, runs_of(lines, states))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "part", "nth", "role", "opens", "text", "rendered"])

    return turns.mapInArrow(work, "conv_id long, part int, nth long, role string, opens boolean, text string, rendered string")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation: written as a raw transcript with missing and mixed markers, parsed by Viterbi, rendered canonically."""
    rows = table(spark, sf_dir, "conversations")
    return format_frame(rows, fit(rows))
