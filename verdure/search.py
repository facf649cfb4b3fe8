"""Ranked document search (BM25) over any table of texts."""

from __future__ import annotations

import ast
import json
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure import scratch
from verdure.functions.text import once, tokens

K1, B, CHUNK = 1.5, 0.75, 1200


def terms(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, len): one row per chunk and distinct term, in one pass without a shuffle."""
    rows = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    rows = rows.select("id", F.size("words").alias("len"), F.explode("words").alias("term"))
    return rows.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def search(chunks: DataFrame, query: str, k: int = 5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Top k chunks (id, score); ties go to the higher id.  Query terms count as often as they are repeated.

    Every text is cut into words once: its length and the frequencies of the
    query's terms go to a small scratch table, from which statistics and scores
    are taken.  Nothing but matching chunks is shuffled.
    """
    wanted = Counter(_words(query))
    counted = once(tokens(F.col(text_col)), lambda words: F.array(F.size(words), *(F.size(F.filter(words, _is(t))) for t in wanted)))
    at = scratch.shared_dir(chunks.sparkSession, "search")
    found = chunks.select(F.col(id_col).alias("id"), F.coalesce(counted, F.array_repeat(F.lit(0), 1 + len(wanted))).alias("n"))
    found.write.parquet(at)
    found = chunks.sparkSession.read.schema(found.schema).parquet(at)
    rows = found.select("id", F.col("n")[0].alias("len"), *(F.col("n")[i + 1].alias(f"tf{i}") for i in range(len(wanted))))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    both = rows.where(F.greatest(F.lit(0), *(F.col(f"tf{i}") for i in range(len(wanted)))) > 0).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i, n in enumerate(wanted.values()):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + n * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(max(1, k))


def _is(term: str):
    return lambda w: w == F.lit(term)


def _words(query: str) -> list[str]:
    from verdure.functions.text import STOP

    found = re.findall("[a-z0-9_]+", query.lower())
    return [w for w in found + [p for w in found if "_" in w for p in w.split("_") if p] if w not in STOP]


def package_docs(spark):
    """(id, source, text) chunks of this package's own sources and the README beside it."""
    root = Path(__file__).resolve().parent
    files = [*sorted(root.glob("*.py")), *sorted(root.glob("[!_]*/*.py")), *sorted(root.parent.glob("README.md"))]
    parts = [c for f in files for c in chunks_of(str(f.relative_to(root.parent)), f.read_text(encoding="utf-8"))]
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(parts)], "id int, source string, text string")


def split(text: str, limit: int = CHUNK) -> list[str]:
    """Paragraphs packed into chunks of about ``limit`` characters."""
    out, held = [], ""
    for part in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if held and len(held) + len(part) + 2 > limit:
            out.append(held)
            held = ""
        held = f"{held}\n\n{part}" if held and part else held or part
    return out + [held] if held else out


def chunks_of(name: str, text: str) -> list[tuple[str, str]]:
    """(source, text) chunks of a markdown, Python or notebook file."""
    if name.endswith(".py"):
        tree, lines, out = ast.parse(text), text.splitlines(), []
        if doc := ast.get_docstring(tree):
            out += [(name, c) for c in split(doc)]
        for node in tree.body:
            if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
                out += [(f"{name}:{node.name}", c) for c in split("\n".join(lines[node.lineno - 1 : node.end_lineno]))]
        return out
    if name.endswith(".ipynb"):
        cells = json.loads(text).get("cells", [])
        return [(f"{name}#{i}", c) for i, cell in enumerate(cells) for c in split("".join(cell.get("source", [])))]
    out, title = [], ""
    for part in re.split(r"(?m)^(?=#{1,6} )", text):
        if part.startswith("#"):
            title = part.splitlines()[0].lstrip("# ").strip()
        out += [(f"{name} - {title}" if title else name, c) for c in split(part)]
    return out
