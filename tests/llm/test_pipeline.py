"""The pipeline against its stages done slowly, and the registered queries on a small table."""

import hashlib
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_text_operators import SPACES, lower, repeats, slow_tiles, words  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from tidewatch.llm import byte_bpe, simhash_similar, string_tiling  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(17)
    vocabulary = ["".join(rng.choice(list("abcdeou"), rng.integers(2, 7))) for _ in range(600)]
    said = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, said(30)) for i in range(4)]
    base = said(80)
    texts = [None, "", "too short", base, base, base + "\n", base + " tail", items[0][1] + " " + said(30), said(20) + "\n" + " ".join(items[1][1].split()[15:] + items[1][1].split()[:15])]
    texts += [said(40) + "\n  Notice TO all readers\n" + said(30) for _ in range(12)]
    texts += ["% $ " * 60 + said(30), (said(10) + "\n") * 9, ("AB CD " + said(1).upper() + " ") * 20, said(4000)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "extra") for i, t in enumerate(texts)] + [(None, said(60), None, None, None, None), (3, base, "en", "s0", 1, "again")]
    out = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sig string")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), [(r[0], r[1]) for r in rows], items


def slowly(docs, items):
    import public_tokenizers as P

    kept = []
    for i, t in docs:
        t = t or ""
        w, lines = words(t), [s for s in t.split("\n") if words(s)]
        n, chars = len(w), sum(map(len, words(t)))
        bad = n < 20 or 100 * repeats(w) > 30 * n or 10 * sum(c in "#*$%&|<>" for c in t) > n or not 2 * n <= chars <= 10 * n
        bad = bad or 2 * len(set(lines)) < len(lines) or sum("A" <= c <= "Z" for c in t) > sum("a" <= c <= "z" for c in t) or 2 * sum(c.isalpha() for c in t) < chars
        if not bad:
            kept.append((i, t))
    seen = defaultdict(set)
    for i, t in kept:
        for s in t.split("\n"):
            seen[lower(s.strip(SPACES))].add(i)
    often = {k for k, ids in seen.items() if k and len(ids) >= 10}
    kept = [(i, "\n".join(s for s in t.split("\n") if lower(s.strip(SPACES)) not in often)) for i, t in kept]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if simhash_similar.similarity(kept[a][1].encode(), kept[b][1].encode()) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    low = defaultdict(list)
    for (i, _), r in zip(kept, root):
        low[r] += [] if i is None else [i]
    first, out = set(), []
    for (i, t), r in zip(kept, root):
        if i is None or (i == min(low[r]) and i not in first):
            first.add(i)
            out.append((i, t))
    tokens = string_tiling.tokens
    out = [(i, t) for i, t in out if not any(slow_tiles(tokens(t)[:400], tokens(s), 4) >= 0.5 * len(tokens(s)) for _, s in items)]
    enc = byte_bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    done = [(i, enc.encode_ordinary(t), t) for i, t in out]
    return sorted([(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, ids, t in done], key=repr)


def test_pipeline_equals_slow_stages(spark, folder):
    path, docs, items = folder
    want = slowly(docs, items)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, path).collect()), key=repr)
    assert got == want and 10 < len(want) < len(docs) - 6


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), folder[0]).count() == 0


def test_every_query_is_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert set(entry.oracle_sql()) >= {"op2_sharding", "op3_tool_calls", "op6_line_dedup", "op8_quality_cascade"}


def test_near_dedup_takes_the_links_of_fingerprints(spark):
    """Repeats decide a fingerprint, not the set of shingles: such texts are linked by anchors only."""
    phrase = "one two three four five six seven " * 50
    rows = [(1, phrase + "tail of the first text with a few other words"), (2, phrase + "and this is how some second one comes to its end"),
            (3, " ".join(f"w{i * i % 97}x{i}" for i in range(90))), (4, " ".join(f"v{i * i % 89}y{i}" for i in range(90)))]
    texts = [t.encode() for _, t in rows]
    assert simhash_similar.similarity(texts[0], texts[1]) < 0.5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [1, 3, 4]
    assert sorted(r["doc_id"] for r in simhash_similar.keep_one_similar(docs).collect()) == [1, 2, 3, 4]
