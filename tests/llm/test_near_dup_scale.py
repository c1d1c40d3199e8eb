"""Near-duplicates where one neighbourhood is large and mixed, and recall against all pairs of a whole table."""

import collections
import random
import re

import pytest

from tesserae.llm import _common, minhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    w = WORDS.findall(text or "")
    out = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()
    return {(s, k) for s, n in out.items() for k in range(n)}


def links_of(texts, least=0.8):
    """All pairs of different texts that reach ``least``, through an inverted index of their shingles."""
    bags = [bag(t) for t in texts]
    holders = collections.defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            holders[s].append(i)
    common = collections.Counter()
    for held in holders.values():
        for a in range(len(held)):
            for b in range(a):
                common[held[b], held[a]] += 1
    return [(a, b) for (a, b), n in common.items() if n >= least * (len(bags[a]) + len(bags[b]) - n)]


def labels_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def mixed_group(n, seed):
    """Variants of one text, from nearly equal to barely alike, and variants of variants, so that chains of links arise."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    made = []
    for i in range(n):
        start = base if not made or rng.random() < 0.5 else rng.choice(made).split()
        words = list(start)
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8))):
            words[rng.randrange(len(words))] = f"x{i}y{rng.randrange(10**6)}"
        made.append(" ".join(words))
    return made


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_large_mixed_group(spark, monkeypatch, broadcast):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "STARS", 2)
    monkeypatch.setattr(_common, "BROADCAST_ROWS", broadcast)
    texts = mixed_group(220, 3)
    distinct = sorted(set(texts))
    label = dict(zip(distinct, labels_of(len(distinct), links_of(distinct)), strict=True))
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(label[t], i)
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(i, least[label[t]]) for i, t in enumerate(texts)]
    assert len(set(label.values())) > 5


def test_recall_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(map(tuple, docs.collect()))
    ids = sorted(texts)
    links = links_of([texts[i] for i in ids])
    cls = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    found = sum(cls[ids[a]] == cls[ids[b]] for a, b in links)
    assert len(links) > 50 and found >= 0.99 * len(links)
    # Nothing is joined that no chain of links joins.
    want = labels_of(len(ids), links)
    mates = collections.defaultdict(set)
    for i, w in zip(ids, want, strict=True):
        mates[cls[i]].add(w)
    assert all(len(m) == 1 for m in mates.values())


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_common, "shared_dir", lambda _: f"file://{tmp_path}")
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, None)], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 3
    assert sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "tesserae").iterdir()) == ["classes", "signed"]
