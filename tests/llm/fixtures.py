"""Small corpora that hold every awkward case, and brute-force results for them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
NAMES = ["key", "node", "text_hash", "n", "score", "words", "piece", "part", "item", "held_out", "spans", "member"]


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus() -> list[tuple]:
    """Rows of doc_id, text, lang, source, n_chars: nulls, empty and long texts, copies, near copies, repeats, ties."""
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(30, 90)) for _ in range(12)]
    passage = prose(rng, 45)
    texts: list[str | None] = [*base, base[0], base[0].upper(), base[1] + " tail", base[2] + "\n\n", None, "", " \t\n\x0b ", "one"]
    texts += ["two words", "three short words", "é ß 　 \x1c x", "...", "12 34", prose(rng, 6000, 5000)]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 15)}" for _ in range(4)]
    texts += ["again " * 120, "to and fro " * 60, passage + " " + passage]
    for _ in range(30):  # near copies of one text
        words = base[3].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    rows = [(i, t, rng.choice(["en", "de", None]), "s0", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows += [(None, base[6], "en", None, None), (None, None, None, None, None), (3, base[7], "en", "s1", 1)]
    return rows


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The rows as a table in three partitions, with columns whose names the operators use inside."""
    rows = corpus() if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES)
    return spark.createDataFrame([(*r, *[0] * len(NAMES)) for r in rows], schema).repartition(3)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    text = text or ""
    return (text.translate(LOWER) if lower else text).encode().split()


def group(n: int, links: list[tuple[int, int]]) -> list[int]:
    """For each of n rows, the smallest row that links reach."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
