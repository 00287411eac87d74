"""Each stage against what it is for, and the whole against brute force, on the small test table."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from sluice.llm.common import WORD
from sluice.llm.quality import quality

from sluice.llm import line_dedup, tokens

from .test_operators import W, brute_components, brute_verdicts

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        seen.append((before, docs))
        if i < 4:
            assert docs.dtypes == spark.read.parquet(f"{SF}/documents.parquet").dtypes
    (source, kept), (_, lines), (_, single), (_, mixed), (_, packed) = seen
    want = {r.doc_id for r in quality(source).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < source.count()
    assert lines.count() == kept.count()
    rows = sorted((r.doc_id, r.text) for r in lines.collect())
    _, group = brute_components([t for _, t in rows], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted({g: rows[g][0] for g in group}.values())
    words, taken = {r.doc_id: Counter(W.findall(r.text)) for r in single.collect()}, defaultdict(Counter)
    for r in mixed.collect():
        taken[r.doc_id] += Counter(W.findall(r.text))
    assert all(n <= 2 * words[d][w] for d, c in taken.items() for w, n in c.items())
    assert abs(sum(sum(c.values()) for c in taken.values()) / sum(sum(c.values()) for c in words.values()) - 1.5) < 0.05
    pieces = packed.collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0) and all(len(p.ids) == p.length for p in pieces)
    assert all(zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids)) == p.ids_crc32 for p in pieces)
    assert WORD and corpus_pipeline.ORACLE_SQL is None


def brute_single(rows):
    """Ids that stay of rows (doc_id, text, lang, source) after quality rules, line dedup and near dedup; texts and sources by id."""
    kept, _ = brute_verdicts([r[1:4] for r in rows])
    rows = [r for r, k in zip(rows, kept, strict=True) if k]
    pages, counts = Counter(r[3] for r in rows), Counter()
    for r in rows:
        counts.update((r[3], x) for x in set(r[1].split("\n")) if W.search(x))
    bad = {k for k, n in counts.items() if n >= line_dedup.LEAST and n > line_dedup.SHARE * pages[k[0]]}
    rows = sorted((r[0], "\n".join(x for x in r[1].split("\n") if (r[3], x) not in bad), r[3]) for r in rows)
    _, group = brute_components([t for _, t, _ in rows], 5, 80)
    least = {}
    for r, g in zip(rows, group, strict=True):
        least.setdefault(g, r[0])
    return set(least.values()), {r[0]: r[1:] for r in rows}


def test_run_against_brute_force(spark):
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    stay, texts = brute_single(rows)
    pieces = corpus_pipeline.run(spark, SF).collect()
    encode = Tokenizer.from_file(tokens.default_tokenizer()).encode
    got, sequences, end = defaultdict(Counter), defaultdict(list), 2
    for p in pieces:
        got[p.doc_id].update(p.ids)
        sequences[p.sequence_id].append((p.offset, p.length))
    words = {d: len(W.findall(texts[d][0])) for d in stay}
    assert set(got) <= {d for d in stay if words[d]}
    whole = {d: Counter(encode(texts[d][0], add_special_tokens=False).ids) for d in stay}
    for d, ids in got.items():  # a word's ids don't depend on what stands beside it, so no document gives more than twice its own
        passes = ids.pop(end)
        assert 1 <= passes <= 2 and all(n <= 2 * whole[d][i] for i, n in ids.items())
    for s in {texts[d][1] for d in stay}:  # the sources' shares, in ids
        own, took = (sum(sum(x[d].values()) for d in stay if d in x and texts[d][1] == s) for x in (whole, got))
        assert took <= 2 * own
    total = sum(sum(x.values()) for x in got.values())
    assert abs(total / sum(sum(x.values()) for x in whole.values()) - 1.5) < 0.05
    for x in sequences.values():
        x.sort()
        ends = [0]
        for o, n in x:
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 4096 and ends[-1] & (ends[-1] - 1) == 0
