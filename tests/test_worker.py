import sys

from meshlark.functions.worker import once


def test_a_stage_does_not_keep_what_an_earlier_one_learned():
    held = sys.__dict__.setdefault("_meshlark_held", {})
    before = dict(held)
    held.clear()
    try:
        once("words", dict)
        first = once(("ranks", 1), dict)
        assert "words" not in held
        once(("ranks", 2), dict)
        assert once(("ranks", 1), dict) is first and len(held) == 2
    finally:
        held.clear()
        held.update(before)
