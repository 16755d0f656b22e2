import numpy as np

from shiftlens.llm import embeddings


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [c + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.3]) for c in centres for _ in range(25)]
    rows += [rows[0]] * 30 + list(rng.normal(size=(60, 16)))
    vectors = [(k, [float(np.float32(x)) for x in r]) for k, r in enumerate(rows)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] + [0.0] * 14), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, block=16).collect()}
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert [got[k].n_links for k in range(len(x))] == near.sum(axis=1).tolist()
    label = np.arange(len(x))
    while True:
        nxt = np.array([min(label[k], label[near[k]].min(initial=10**9)) for k in range(len(x))])
        if (nxt == label).all():
            break
        label = nxt
    assert [got[k].component_id for k in range(len(x))] == label.tolist()
    assert all(got[k].n_links == 0 and got[k].kept for k in range(900, 905)) and got[906].component_id == 905
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_tables_reach_the_recall():
    for bits in (8, 14, 24):
        same = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - same) ** embeddings.tables_for(bits, 0.95, 0.999) >= 0.999
