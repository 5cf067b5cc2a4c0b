"""The pipeline, stage by stage, against brute force on each stage's own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import public_tokenizers
from test_dedup import jaccard_brute
from tokenizers import Tokenizer

from shardwright.llm.scratch import stage

SF = "/root/testdata/sf0.001"


def as_rows(frame):
    return sorted((tuple(r) for r in frame.select(*cp.COLUMNS).collect()), key=repr)


def test_stages(spark, docs):
    quality, exact, near, mix, pack = (f for _, f in cp.STAGES)
    start = stage(spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs.select(*cp.COLUMNS)), "start")
    good = stage(quality(spark, start, SF), "good")
    assert not Counter(as_rows(good)) - Counter(as_rows(start))
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    assert len([r for r in as_rows(good) if r[0] in bad]) <= 0.2 * len(bad)

    unique = stage(exact(spark, good, SF), "unique")
    groups = defaultdict(list)
    for r in as_rows(good):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    last = 1 << 62
    want = [min(g, key=lambda r: (last if r[0] is None else r[0])) for g in groups.values()]
    assert Counter(r[0] for r in as_rows(unique)) == Counter(r[0] for r in want)
    assert len(as_rows(unique)) == len(groups)

    single = stage(near(spark, unique, SF), "single")
    rows = as_rows(unique)
    members = defaultdict(list)
    for r, (_, c) in zip(rows, jaccard_brute([r[1] for r in rows])):
        members[c].append(r)
    kept = as_rows(single)
    assert len(kept) == len(members)
    for group in members.values():
        ids = [r[0] for r in group if r[0] is not None]
        assert len([r for r in group if r in kept]) == 1 and (not ids or any(r[0] == min(ids) for r in group if r in kept))

    mixed = stage(mix(spark, single, SF), "mixed")
    repeats = Counter(as_rows(mixed))
    assert set(repeats) <= set(kept) and max(repeats.values()) <= 3
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in kept}
    assert abs(sum(n * size[r] for r, n in repeats.items()) - sum(size.values())) <= 0.1 * sum(size.values())

    packed = pack(spark, mixed, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(n * (1 + len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r, n in repeats.items())
    assert sum(r["length"] for r in packed) == tokens
    assert len([r for r in packed if r["piece"] == 0]) == sum(repeats.values())


def test_empty_input(spark, no_docs):
    for _, apply in cp.STAGES:
        out = apply(spark, stage(no_docs, "none"), SF)
        assert out.count() == 0
    assert [name for name, _ in cp.STAGES][0] == "quality classifier" and len(cp.STAGES) == 5


def test_registered_with_every_operator():
    import __spark_entry__ as ent

    names = ent.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
