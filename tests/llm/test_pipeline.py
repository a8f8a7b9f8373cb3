import hashlib
import re
from collections import Counter

import __spark_entry__ as job
import corpus_pipeline
import numpy as np
import public_tokenizers
from conftest_llm import SMALL, by_id
from passagelake.session import materialise
from test_mixing import size_of, targets
from test_near_dup import brute
from test_pii import PLAIN
from test_pii import brute as spans_of
from test_quality import counts
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, small):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text for r in small.collect()}
    before, frame, seen = docs, small, []
    for name, stage in corpus_pipeline.STAGES:
        frame = materialise(stage(spark, frame, SMALL), f"test-{name}")
        if name == "encoding":
            break
        assert frame.columns == COLUMNS
        rows = frame.collect()
        texts = {r.doc_id: r.text for r in rows}
        if name == "quality":
            assert set(texts) <= set(before) and all(texts[d] == before[d] for d in texts)
            failed = {d for d, t in before.items() if counts(t)[0] < 50 or 2 * counts(t)[4] > counts(t)[0]}
            assert not failed & set(texts) and len(texts) > 0.9 * (len(before) - len(failed)) - 20
        if name == "near_dup":
            assert set(texts) == {d for d, (_, _, kept) in brute(list(before.items())).items() if kept}
        if name == "pii":
            assert set(texts) == set(before)
            for d, t in before.items():
                for span in filter(None, spans_of(t).split(",")):
                    kind, start, end = span.split(":")
                    assert t[int(start) : int(end)] not in texts[d] and f"[{kind.upper()}]" in texts[d]
                if not spans_of(t):
                    assert texts[d] == t
        if name == "mixing":
            source = {r.doc_id: r.source for r in small.collect()}
            sizes, taken = Counter(), Counter()
            for d, t in before.items():
                sizes[source[d]] += size_of(t)
            for r in rows:
                taken[r.source] += size_of(r.text)
                assert not Counter(r.text.split()) - Counter(before[r.doc_id].split())
            for s, target in targets(sizes).items():
                assert abs(taken[s] - target) <= 96
            texts = rows
        seen.append(name)
        before = texts
    assert seen == ["quality", "near_dup", "pii", "mixing"]
    want = Counter()
    for r in before:
        ids = own.encode(r.text, add_special_tokens=False).ids
        text = own.decode(ids, skip_special_tokens=False)
        want[r.doc_id, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.ids_sha256, r.text, r.decoded_sha256) for r in frame.collect()) == want


def test_run_and_registration(spark, odd, empty):
    names = set(job.queries())
    assert "pipeline" in names and {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op") and re.match(r"op\d+_", n)} == {str(n) for n in range(1, 14)}
    assert corpus_pipeline.run(spark, SMALL).count() > 100 and PLAIN
    for frame in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            frame = materialise(stage(spark, frame, SMALL), f"test-odd-{name}")
    assert frame.count() == 0 and by_id(frame) == {}
