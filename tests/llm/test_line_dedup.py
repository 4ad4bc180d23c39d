"""Line dedup against its definition, line by line in plain Python."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tests.llm.data import prose

from rivulet.llm import line_dedup as L


def by_definition(spark, texts):
    """The lines that go. Spark computes the hashes that order cells which are equally frequent, nothing else."""
    rows = [set(t.split("\n")) for t in texts]
    kinds = Counter(line for r in rows for line in r)
    parts = {line: line.strip(" ").split() for line in kinds if line.strip()}
    variable = lambda t: any(c.isdigit() for c in t)
    leaf = {line: (len(p), " ".join("<*>" if variable(t) else t for t in p[:3])) for line, p in parts.items() if len(p) >= 4}
    known = spark.createDataFrame([(line, n, lead) for line, (n, lead) in leaf.items()], "line string, n int, lead string")
    placed = known.select("line", F.xxhash64("n", "lead").alias("leaf"), F.posexplode(F.split("line", " ")).alias("at", "token"))
    cells = defaultdict(list)
    for r in placed.select("line", "token", F.xxhash64("leaf", "at", "token").alias("cell")).collect():
        if not variable(r.token):
            cells[r.line].append(r.cell)

    def templates(lines, group):
        """{line: template}: its most frequent cells in its group, if there are enough frequent ones."""
        count = Counter()
        for line in lines:
            for c in cells[line]:
                count[group[line], c] += kinds[line]
        out = {}
        for line in lines:
            need = math.ceil(len(parts[line]) * L.CONSTANT)
            best = sorted((-count[group[line], c], c) for c in cells[line] if count[group[line], c] >= L.LEAST_DOCS)[:need]
            if len(best) == need:
                out[line] = group[line], frozenset(c for _, c in best)
        return out

    def recurring(of):
        held = Counter(t for r in rows for t in {of[line] for line in r if line in of})
        return {line for line, t in of.items() if held[t] >= L.LEAST_DOCS}

    gone = {line for line in parts if kinds[line] >= L.LEAST_DOCS}
    in_leaf = Counter()
    for line in leaf:
        for c in cells[line]:
            in_leaf[c] += kinds[line]
    frequent = {line: [c for c in cells[line] if in_leaf[c] >= L.LEAST_DOCS] for line in leaf}
    cells.update(frequent)
    gone |= recurring(templates(leaf, leaf))
    rest = [line for line in leaf if line not in gone and cells[line]]
    return gone | recurring(templates(rest, {line: min((in_leaf[c], c) for c in cells[line]) for line in rest}))


def test_equals_its_definition(spark):
    rng = random.Random(6)
    texts = []
    for i in range(300):
        lines = [prose(rng, rng.randint(1, 12)) for _ in range(rng.randint(0, 5))]
        lines += rng.sample(["all rights reserved", "home", "read more about this site here", "terms of use apply to all of it"], rng.randint(0, 2))
        for shape in ("posted by {} on {} in general news", "user {} logged in from {} at node {}", "{} items found for {} sorted by date", "page {} of {} next last"):
            if rng.random() < 0.15:
                lines.append(shape.format(*[rng.choice([str(rng.randint(1, 9999)), prose(rng, 1), "north"]) for _ in range(3)]))
        lines += ["", lines[0]] if lines and rng.random() < 0.2 else []
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    gone = by_definition(spark, texts)
    got = L.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        lines = texts[r.doc_id].split("\n")
        kept = [line for line in lines if line not in gone]
        assert (r.text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert any(any(c.isdigit() for c in line) for line in gone) and "home" in gone and len(gone) < len({x for t in texts for x in t.split("\n")}) / 2
