"""Small tables with the cases that every operator must handle."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def prose(seed, n):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice(["ta", "re", "mi", "so", "lu", "né", "ka", "Bo"]) for _ in range(rng.randint(1, 4)))
    return " ".join(make() + ("." if i % 9 == 8 else "") for i in range(n))


def edited(text, seed, every):
    rng = random.Random(seed)
    return " ".join(f"x{rng.randint(0, 999)}" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


def documents():
    """(doc_id, text): copies, near copies, passages, empty, null, repeated and long rows."""
    a, b, c, p = prose(1, 220), prose(2, 180), prose(3, 90), prose(4, 70)
    rows = [(10, a), (3, a), (12, edited(a, 5, 40)), (4, edited(a, 6, 45)), (20, b), (21, b + " extra words here"), (22, c), (30, None), (31, ""), (32, " \t\n "), (33, "one"), (34, "one"), (35, "One two"), (None, prose(9, 60)), (None, None)]
    rows += [(40, prose(10, 80) + " " + p + " " + prose(11, 60)), (41, prose(12, 50) + "\n" + edited(p, 7, 20) + "\n" + prose(13, 75)), (42, prose(14, 120))]
    rows += [(50, prose(15, 9000)), (22, c), (51, "a\x0bb\x0cc\u00a0d \x1fe"), (52, "ÀÉ Ünïcode 漢字 🙂 e\u0301 <|endoftext|> it's  two  spaces\n\n 12345")]
    return rows


def table(spark, rows=None):
    """With extra columns whose names clash with what operators add."""
    rows = documents() if rows is None else rows
    more = [(i, t, "x", 1.5, "y", i) for i, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, kept string, n double, token string, component_id long")


def words(text, lower=True):
    t = text or ""
    return WORD.findall(t.translate(LOWER) if lower else t)
