import pytest

from facetline.plans import options as O


def test_durations():
    assert [O.seconds(t) for t in ("2s", "100ms", "1m30s", "1.5h", "0", "-1s", ".5s")] == pytest.approx([2, 0.1, 90, 5400, 0, -1, 0.5])
    for bad in ("", "2", "s", "1 s", "1s ", "1d", "1s2"):
        with pytest.raises(O.OptionError):
            O.seconds(bad)


def test_scan_options():
    o = O.scan_options(0.4, 3, "500ms", "1s", 10.0)
    assert (o.threshold, o.nth, o.max_gap, o.blip) == (0.4, 3, 5, 1.0)
    for bad in ({"threshold": 1.1}, {"threshold": float("nan")}, {"threshold": -0.1}, {"nth": 0}, {"grace": "0s"}, {"blip": "-1s"}, {"blip": "x"}, {"detection": 2.0}, {"timeout": "0"}, {"fps": 0.0}):
        with pytest.raises(O.OptionError):
            O.scan_options(**bad)
    O.scan_options(0.0)
    O.scan_options(1.0)


def test_redact_options():
    assert O.redact_options([]).mode == "blur-all" and O.redact_options([1]).mode == "targeted" and O.redact_options([1], "targeted", linger="2s", fps=10.0).linger_frames == 20
    for targets, bad in (([], {"mode": "targeted"}), ([1], {"mode": "blur-all"}), ([1], {"mode": "all"}), ([1], {"style": "mosaic"}), ([1], {"strength": -1}), ([1], {"scale": 0.0}), ([1], {"linger": "1"}), ([1], {"threshold": 2.0}), ([1], {"detection": -1.0})):
        with pytest.raises(O.OptionError):
            O.redact_options(targets, **bad)
