import numpy as np

from netloom.llm import decontaminate as dc
from netloom.llm.pieces import Keys


def test_windows_far_from_what_an_item_needs_are_left_out():
    """One item in a long text that shares single words with it throughout: hits stay, most windows go."""
    words = [f"w{k}" for k in range(20)]
    text = " ".join([*(f"x{k} w{k % 3}" for k in range(1000)), *words, *(f"y{k} w{k % 3}" for k in range(1000))])
    flat, _ = dc.hashed([" ".join(words)])
    items, features = [flat.tolist()], np.unique(flat)
    passages, owner = dc._passages(items)
    basis = np.eye(len(features), dtype=np.float32)
    latent = np.stack([basis[np.searchsorted(features, np.array(p, np.uint64))].sum(axis=0) for p in passages])
    weights = np.linalg.norm(latent, axis=1)
    made = (items, [[]], Keys(features, np.arange(len(features), dtype=np.int32)), np.ones(len(features)), basis, np.ascontiguousarray((latent / weights[:, None]).T), weights, owner)
    index, plain = dc.Index([5], *made, dc._counts(items, features)), dc.Index([5], *made)
    found, bounds = dc.hashed([text, "", " ".join(words[:11]), " ".join(words[:12])])
    able = dc._able(index, index.keys.get(found), bounds)
    assert able[2000:2020].all() and able.sum() < 400 and dc._able(plain, index.keys.get(found), bounds).all()
    assert not able[bounds[2] : bounds[3]].any() and able[bounds[3] :].all()
    texts = [text, "", " ".join(words[:11]), " ".join(words[:12])]
    assert dc._searched(texts, index) == dc._searched(texts, plain) == [{0: 1.0}, {}, {}, {0: 0.6}]
