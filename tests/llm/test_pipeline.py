import hashlib
import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lodestream.llm import bpe, toxicity
from lodestream.session import settle, table

from .test_near_dup import plain as components
from .test_quality import plain as counts


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    outs = [docs]
    for name, stage in cp.STAGES:
        outs.append(settle(stage(spark, outs[-1], sf), "t"))
        if name != cp.STAGES[-1][0]:
            assert outs[-1].dtypes == docs.dtypes
    rows = [d.collect() for d in outs]
    # quality: what the base rule rejects is gone; here no line stands in more than 20 different documents of a source
    stay = {r.doc_id: r.text for r in rows[0] if (c := counts(r.text))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert {r.doc_id: r.text for r in rows[1]} == stay
    # toxicity: the same decisions as the operator's scores
    model = toxicity.learn(docs, table(spark, sf, "labels"))
    matcher = toxicity.Matcher(model)
    fine = {d for d, t in stay.items() if model.score(np.array([matcher.evidence(t)[0]]))[0] < toxicity.THRESHOLD}
    assert {r.doc_id for r in rows[2]} == fine and fine <= set(stay)
    label = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert all(d in fine for d, t in label.items() if t == 0 and d in stay)
    # near duplicates: brute force over all pairs that share a shingle
    kept = {d for d, _, _, k in components(sorted((r.doc_id, r.text) for r in rows[2]), 5, 80) if k}
    assert {r.doc_id for r in rows[3]} == kept
    # the mix: only words of the documents, none more than twice, about 1.5 times all of them
    size, taken = {r.doc_id: n_words(r.text) for r in rows[3]}, Counter()
    text = {r.doc_id: r.text.split() for r in rows[3]}
    for r in rows[4]:
        taken[r.doc_id] += n_words(r.text)
        assert not Counter(r.text.split()) - Counter(text[r.doc_id])
    assert all(taken[d] <= 2 * size[d] for d in size) and abs(sum(taken.values()) - 1.5 * sum(size.values())) < 30
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = Counter((r.doc_id, hashlib.sha256(np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in rows[4])
    assert Counter((r.doc_id, r.ids_sha256) for r in rows[5]) == want


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 0 and [len(x) for x in cp.STAGES] == [2] * 5
