import math

import pytest

from edgelight.plans.request import POPS, RequestError, TriageRequest, decode_filters, from_form, is_small_talk, looks_like_triage, options, parse_chat, parse_command, parse_window


@pytest.mark.parametrize("given,minutes", [("90", 90), ("2h", 120), ("1d", 240), ("5M", 5), ("", 60), ("x", 60), ("-5", 60)])
def test_windows(given, minutes):
    assert parse_window(given) == minutes


def test_command():
    r = parse_command("service=VOD service= region=USW2, window=2h debug edge_status=5xx edge_status=404x crc=a|b crc_class=Error odd=1 crc=x,y")
    assert (r.service, r.region, r.window_minutes, r.debug) == ("all", "usw2", 120, True)
    assert r.filters == (
        {"key": "edge_status", "type": "range", "min": 500, "max": 599},
        {"key": "edge_status", "type": "eq", "value": 404},
        {"key": "crc", "type": "in", "values": ["A", "B"]},
        {"key": "crc_class", "type": "eq", "value": "error"},
        {"key": "crc", "type": "eq", "value": "X"},
    )
    assert math.isnan(parse_command("edge_status=xxx").filters[0]["min"])
    assert parse_command("debug=no").debug is False


def test_form():
    r = from_form({"service": "vod", "windowMinutes": "1.5", "filters": '[{"key":"crc"}]', "debug": "ON"})
    assert r == TriageRequest("vod", "all", "all", 1.5, ({"key": "crc"},), True)
    for bad in ("0", "-1", "x", "inf"):
        with pytest.raises(RequestError):
            from_form({"windowMinutes": bad})
    with pytest.raises(RequestError):
        from_form({"filters": "{"})
    assert decode_filters("{") == decode_filters({}) == decode_filters(None) == ()


def test_chat():
    current = TriageRequest(region="usw2", window_minutes=45)
    assert parse_chat("svc = vod win=30", current).request == TriageRequest("vod", "usw2", "all", 30)
    assert parse_chat("pop=sjc win=2h", current).request.window_minutes == 45
    assert "region=mars" in parse_chat("region=mars pop=moon").answer and "pop=moon" in parse_chat("region=mars pop=moon").answer
    assert parse_chat("win=0").request is None
    assert parse_chat("hi service=vod").answer.startswith("Hey!")
    assert parse_chat("tell me more").answer.startswith("I didn't")


def test_talk():
    assert [is_small_talk(x) for x in ("", "ok", "no", "hiya", "thank you all", "what's up")] == [True, True, False, False, True, True]
    assert [looks_like_triage(x) for x in ("", "a=b", "show errors", "weather")] == [False, True, True, False]
    assert options(POPS)[:3] == ["all", "dfw", "iad"]
