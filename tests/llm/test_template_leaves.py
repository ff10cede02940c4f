"""Leaves of the log-template tree that hold several templates, short lines and numbers."""

import random

from dealscope.llm import line_templates


def test_several_templates_in_a_leaf(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    tails = ["{} from our team will gladly answer your call", "this page was seen by {} on the way", "{} other prose"]
    rows = []
    for i in range(90):
        kind = 0 if i < 20 else 1 if i < 40 else 2
        tail = tails[kind].format(word()) if kind < 2 else prose(9)
        rows.append((i, f"{prose(40)}\nPlease note that {tail}\n{prose(30)}"))
    got = {r.doc_id: r.dropped_lines for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == [1] for i in range(40)) and all(got[i] == [] for i in range(40, 90))


def test_short_numeric_and_mostly_boilerplate_lines(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    banner = [prose(12) for _ in range(4)]  # over half of each of these pages
    rows = [(i, "\n".join([banner[0], banner[1], "Read more", prose(30), f"2024-01-{i:02d} 10:11:{i:02d} 10.0.0.{i} GET", f"{i} {i} {i}", banner[2], banner[3]]), i) for i in range(1, 31)]
    family = [prose(9) for _ in range(8)]
    rows += [(100 + i, "\n".join(prose(9) if rng.random() < 0.1 else x for x in family), 7) for i in range(60)]  # near copies of one text
    rows += [(200 + i, f"One line with the number {i} and no more", 7) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dropped_lines long")
    want = {i: [0, 1, 2, 4, 6, 7] for i in range(1, 31)}
    for broadcast in (line_templates.BROADCAST, 0):
        out = line_templates.drop_recurring_lines(df, broadcast=broadcast)
        assert out.columns == ["doc_id", "text", "dropped_lines", "dropped_lines_"]
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == len(rows) and all(got[d].dropped_lines == n for d, _, n in rows)
        assert {d: r.dropped_lines_ for d, r in got.items()} == {d: want.get(d, []) for d in got}
