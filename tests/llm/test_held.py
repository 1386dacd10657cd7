"""What a Python worker keeps between tasks goes when the worker serves another stage."""

import pyarrow as pa

from recordlake.llm import shared


def test_held_for_one_stage(monkeypatch):
    now = [1]
    monkeypatch.setattr(shared, "_HELD", {})
    monkeypatch.setattr(shared, "_stage", lambda: now[0])
    first = shared.held("a", list)
    texts = [pa.record_batch([pa.array(["x", "y"])], ["t"])]
    assert len(list(shared.slices(texts, 0))) == 1 and shared.held("a", list) is first
    now[0] = 2
    assert len(list(shared.slices(texts, 0))) == 1 and not shared._HELD
    assert shared.held("a", list) is not first


def test_encoder_is_held():
    import public_tokenizers

    from recordlake.llm import pieces

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    assert pieces.encoder(model) is pieces.encoder(model) and any("pieces" in k for k in shared._HELD)
    shared._HELD.clear()
