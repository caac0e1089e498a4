"""The pipeline's near-duplicate stage goes by fingerprints too."""

import corpus_pipeline
from chronolith.llm import similar, simhash


def test_texts_whose_fingerprints_agree_are_one_group(spark, documents):
    """Nearly all of two texts is one passage, many times; their distinct shingles differ, their fingerprints do not."""
    body = "never change a running system " * 80
    tails = [" ".join(f"{x}{i}" for i in range(12)) for x in "pq"]
    docs = documents([(1, body + tails[0]), (2, body + tails[1]), (3, "a text of its own that nobody has copied so far"), (4, "a text of its own that nobody has copied so far")])
    a, b = (simhash.fingerprint((body + t).encode()) for t in tails)
    assert (a ^ b).bit_count() <= 2 and len({r.root for r in similar.groups(docs).where("doc_id <= 2").collect()}) == 2
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
