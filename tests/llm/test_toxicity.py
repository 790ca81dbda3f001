import random

import numpy as np
import pyarrow as pa
from llm_cases import ROWS, none, odd

from pagewright.llm.toxicity import fit, score_documents, train, words_of


def corpus(n, seed, stems):
    draw = random.Random(seed)
    syllables = ["ba", "ne", "lo", "ti", "ru", "sha", "mon", "ver"]
    rows = []
    for i in range(n):
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(draw.randint(5, 60))]
        toxic = i % 4 == 0
        for _ in range(max(1, len(words) // 20) if toxic else 0):
            words[draw.randrange(len(words))] = draw.choice(stems) + draw.choice(syllables)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_unseen_spellings_share_n_grams():
    rows = corpus(900, 1, ["grxwk", "plozzq"])
    model = fit([r[1] for r in rows], np.array([r[2] for r in rows]), np.ones(len(rows)))
    for stems, least in ((["grxwk", "plozzq"], 0.99), (["grxwkk", "plozzqy"], 0.95)):
        rows = corpus(300, 2, stems)
        score, toxic = model.score(pa.array([r[1] for r in rows])), np.array([r[2] for r in rows]) == 1
        # How often a toxic text stands above a clean one.
        assert (score[toxic][:, None] > score[~toxic][None, :]).mean() > least
    assert 0 <= model.score(pa.array([""]))[0] < 0.5


def test_words_are_bags_of_their_n_grams():
    found = words_of(pa.array(["abc abc", "", "x abc"]))
    assert found.per_text.tolist()[0] == 2 and found.per_text.tolist()[2] == 2
    assert found.words[0] == found.words[1] == found.words[-1]
    assert len(found.grams) == found.per_word.sum()


def test_training_skips_held_out_rows_and_odd_rows_are_scored(spark):
    import zlib

    rows = corpus(400, 3, ["grxwk"])
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    # Held-out rows are labelled the wrong way round: they must not matter.
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows]
    labels = [(r[0], 1 - r[2] if h else r[2]) for r, h in zip(rows, held)] + [(None, 1), (5, None), (10**9, 1)]
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(docs, marked)
    scored = {r["doc_id"]: r for r in score_documents(docs, model).collect()}
    right = [scored[r[0]]["predicted"] == r[2] for r in rows]
    assert np.mean(right) > 0.97
    found = score_documents(odd(spark), model).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 and r["label"] == "x" for r in found)
    assert len({r["score"] for r in found if not (r["text"] or "").strip()}) <= 2


def test_without_labels_nothing_is_toxic(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(odd(spark), labels)
    assert {r["predicted"] for r in score_documents(odd(spark), model).collect()} == {0}
    assert score_documents(none(spark), model).count() == 0


def test_a_repeated_identifier_brings_one_text_to_the_driver(spark, monkeypatch):
    import pagewright.llm.toxicity as module

    taken = []
    monkeypatch.setattr(module, "fit", lambda texts, y, weights: taken.append((texts, y.tolist(), weights.tolist())))
    rows = [(1, f"text {i}") for i in range(2_000)] + [(2, "clean"), (3, None), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 9)], "doc_id long, toxic int")
    train(docs, labels, per_label=10)
    train(docs.repartition(7), labels, per_label=10)
    assert taken[0] == taken[1] and len(taken[0][0]) == len(taken[0][1]) <= 3
