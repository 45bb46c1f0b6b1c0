"""Links, threads and texts: by hand, and against a brute-force reading of the same rules."""

import random
import re

from findwell.llm.quotations import K, in_reply_order, linked

SCHEMA = "conv_id long, turn long, role string, text string, path string, line int"
COLUMNS = ["conv_id", "turn", "role", "parent_turn", "root_turn", "depth", "quoted_turns", "n_quoted", "text"]


def build(spark, rows):
    got = in_reply_order(linked(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)))
    assert got.columns == COLUMNS
    return [tuple(r) for r in got.collect()]


def lines_of(text):
    out = []
    for x in re.split(r"\r?\n", text or ""):
        marks = re.match(r"^((?:[ \t]*>)+)", x)
        out.append((marks[1].count(">"), x[len(marks[1]) :].strip()) if marks else (0, x))
    for i in range(len(out) - 1):
        if out[i][0] == 0 and out[i + 1][0] > 0 and re.match(r"(?i)^.*\bwrote:\s*$", out[i][1]):
            out[i] = (-1, out[i][1])
    return out


def runs(words):
    return {tuple(words[i : i + K]) for i in range(max(1, len(words) - K + 1))} if words else set()


def passages(lines):
    out, fresh, level = [], True, None
    for lv, body in lines:
        if not body.strip():
            fresh = True
            continue
        if fresh or lv != level:
            out.append((lv, []))
        out[-1][1].extend(body.lower().split())
        fresh, level = False, lv
    return out


def best(votes):
    return max(votes, key=lambda s: (votes[s], s), default=None)


def brute(rows):
    wrote, quoted = {}, {}
    for c, t, _, text in rows:
        if c is None or t is None:
            continue
        lines = lines_of(text)
        for lv, words in passages(lines):
            if lv > 0:
                quoted.setdefault((c, t), set()).add((lv, tuple(words)))
            elif lv == 0:
                wrote.setdefault((c, t), set()).update(runs(words))
        for lv, body in lines:
            if lv == 0 and 0 < len(body.split()) < K:
                wrote.setdefault((c, t), set()).add(tuple(body.lower().split()))
    parent, sources = {}, {}
    for (c, t), found in quoted.items():
        votes = {}
        for lv, words in found:
            own = {}
            for r in runs(words):
                s = max((u for (d, u), w in wrote.items() if d == c and u < t and r in w), default=None)
                if s is not None:
                    own[s] = own.get(s, 0) + 1
                    if lv == 1:
                        votes[s] = votes.get(s, 0) + 1
            if own:
                sources.setdefault((c, t), set()).add(best(own))
        if votes:
            parent[c, t] = best(votes)
    out = []
    for c, t, role, text in rows:
        lines, root, depth = lines_of(text), t, 0
        while (c, root) in parent:
            root, depth = parent[c, root], depth + 1
        own = re.sub(r"\n{3,}", "\n\n", "\n".join(b for lv, b in lines if lv == 0)).strip()
        known = c is not None and t is not None
        out.append((c, t, role, parent.get((c, t)), root if known else None, depth if known else None, sorted(sources.get((c, t), ())), sum(lv > 0 and b != "" for lv, b in lines), own))
    return out


def test_threads(spark):
    rows = [
        (1, 0, "a", "First  point\nSecond point"),
        (1, 1, "b", "> first point\nI agree"),
        (1, 2, "c", "On Monday a wrote:\n> Second   POINT\nNo\n> unknown\nwrote:"),
        (1, 3, "a", ">> first point\n> I agree\n\n\n\nGood"),
        (1, 4, "d", "> > First point\n>> \n>> Second point\n> No\n>\n> I agree\n> \n> Good\nLast"),
        (1, 5, "e", "No"),
        (1, 6, "e", "> No\nlater"),
        (2, 0, "a", "> First point\nother conversation"),
        (2, 0, "a", "> First point\nother conversation"),
        (2, None, "a", "> x\ny"),
        (None, 3, None, None),
    ]
    got = build(spark, rows)
    by = {r[1]: r for r in got if r[0] == 1}
    assert {t: r[3] for t, r in by.items()} == {0: None, 1: 0, 2: 0, 3: 1, 4: 3, 5: None, 6: 5}
    assert {t: r[4:6] for t, r in by.items()} == {0: (0, 0), 1: (0, 1), 2: (0, 1), 3: (0, 2), 4: (0, 3), 5: (5, 0), 6: (5, 1)}
    assert by[4][6] == [0, 1, 2, 3] and by[4][7] == 5
    assert by[2][8] == "No\nwrote:" and by[3][8] == "Good" and by[4][8] == "Last" and by[0][8] == "First  point\nSecond point"
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_wrapped_anew_and_in_part(spark):
    said = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, 0, "a", f"{said}\nok"), (1, 1, "b", "ok\nsomething else"), (1, 2, "c", "> one two three four\n> five six seven\n> eight nine ten eleven twelve\nYes"), (1, 3, "d", "> four five six\n> seven eight nine\n\n> ok\nNo")]
    got = {r[1]: r for r in build(spark, rows)}
    assert got[2][3] == 0 and got[3][3] == 0 and got[3][6] == [0, 1]


def talk(seed):
    """Random conversations: quotes of quotes, wrapped anew, cut, with short lines that many write."""
    r = random.Random(seed)
    rows = []
    for c in range(6):
        held = []
        for t in range(25):
            own = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(r.choice([1, 2, 7, 15]))) for _ in range(r.randrange(1, 4))]
            body = []
            for _ in range(r.choice([0, 1, 1, 2])):
                if held:
                    words = r.choice(held[-r.choice([1, 3, len(held)]) :]).split()
                    a = r.randrange(len(words))
                    words = words[a : a + r.randrange(1, 20)] if r.random() < 0.4 else words
                    step, mark = r.choice([3, 6, 50]), r.choice(["> ", ">", ">> ", " > > "])
                    body += [mark + " ".join(words[i : i + step]) for i in range(0, len(words), step)] + [""] * r.randrange(2)
            body += [x for line in own for x in (line, *[""] * r.randrange(2))]
            held += own
            rows.append((c if r.random() < 0.97 else None, t if r.random() < 0.97 else None, r.choice(["u", None]), "\n".join(body) if r.random() < 0.97 else None))
            if r.random() < 0.05:
                rows.append(rows[-1])
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("findwell.llm.quotations.TURNS", 4)
    rows = talk(3) + [(9, 0, "a", "a long line " * 30_000), (9, 700, "b", "> " + "long line a " * 5_000)]
    got = build(spark, rows)
    want = brute(rows)
    assert sum(w[3] is not None for w in want) > 40
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_order_long_thread_and_empty(spark):
    rows = [(1, 0, "a", "line 0")] + [(1, i, "a", f"> line {i - 1}\nline {i}") for i in range(1, 40)]
    assert [r[4:6] for r in build(spark, rows)] == [(0, i) for i in range(40)]
    assert build(spark, []) == []
