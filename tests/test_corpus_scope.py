import random

import pytest

from textloom.operators.expansion import neighbour_ids
from textloom.plans.corpus import Corpus, IngestConfig

DOCS = "doc_id long, text_column string, text string, metadata map<string,string>"
CONFIG = IngestConfig(chunk_size=6, chunk_overlap=0, expand=True, expand_scope="corpus", expand_max_tokens=5)


def documents(spark, texts):
    return spark.createDataFrame([(i, "text", t, {}) for i, t in texts.items()], DOCS)


def chunks(corpus, set_id):
    rows = corpus.store.open_chunks(set_id).select("owner", "doc_id", "chunk_ix", "variant", "text", "n_tokens").collect()
    return sorted((tuple(r) for r in rows), key=str)


def brute_neighbours(ids, changed):
    """Unchanged documents with chunks that border on a changed one, when those are passed over."""
    ids = sorted(set(ids) - set(changed))
    near = set()
    for c in changed:
        near |= set([i for i in ids if i < c][-1:]) | set([i for i in ids if i > c][:1])
    return near


@pytest.mark.parametrize("seed", range(6))
def test_neighbours_of_changes(spark, seed):
    draw = random.Random(seed)
    ids = draw.sample(range(100), draw.randint(0, 40))
    changed = draw.sample(range(100), draw.randint(1, 12))
    nearest, next_to = neighbour_ids(spark.createDataFrame([(i,) for i in ids], "doc_id long"), changed)
    rest = sorted(set(ids) - set(changed))
    assert brute_neighbours(ids, changed) <= set(nearest) <= set(rest) and not set(nearest) & set(next_to)
    for i in nearest:  # what a neighbour borders on is at hand, unless a change lies between
        place = rest.index(i)
        for other in rest[max(place - 1, 0) : place + 2]:
            assert other in nearest or other in next_to or any(min(i, other) < c < max(i, other) for c in changed)


def test_changes_remake_few_chunks_and_equal_a_full_build(spark, tmp_path):
    draw = random.Random(3)

    def text():
        return " ".join(". ".join(f"w{draw.randrange(30)} x{draw.randrange(30)}" for _ in range(3)) + "." for _ in range(draw.choice([0, 1, 1, 2])))

    texts = {i * 3: text() for i in range(200)}
    corpus = Corpus(spark, str(tmp_path / "store"))
    set_id = corpus.ingest_documents(documents(spark, texts), "s", CONFIG)
    for change in ({300: "only this one."}, {0: "", 3: "", 6: ""}, {301: "a new one.", 302: ""}, {597: "the last. and more.", 900: "behind it."}):
        corpus.upsert_documents(set_id, documents(spark, change))
        texts.update(change)
        newest = corpus.store.read("chunks", set_id, corpus.store.require_set(set_id)["folders"][-1:])
        assert newest.select("owner").distinct().count() <= 2 * len(change) + 1
    fresh = corpus.ingest_documents(documents(spark, texts), "t", CONFIG)
    assert chunks(corpus, set_id) == chunks(corpus, fresh)
    assert corpus.get_set(set_id)["total_documents"] == len(texts)
