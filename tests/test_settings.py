import pytest

from quillspark import settings as st


def test_round_trip(tmp_path):
    path = tmp_path / "d" / "s.toml"
    assert st.Settings.load(path) == st.Settings()
    mine = st.Settings(clients=["thunderbird"], mbox_root='~/a "b"', webmail=True)
    mine.index.poll_seconds = 5
    mine.save(path)
    assert st.Settings.load(path) == mine
    assert st.active(path) is st.active(path)


def test_errors(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text("clients = [")
    with pytest.raises(ValueError):
        st.Settings.load(path)
    assert st.active(path) == st.Settings()
    with pytest.raises(ValueError):
        st.source("nope")
    assert st.expand("~/x") != "~/x" and st.expand("a~") == "a~"


def test_preference():
    assert st.preference([]) == list(st.SOURCES)
    assert st.preference(["plain-mbox", "gone", "plain-mbox"]) == ["plain-mbox", "apple-mail", "thunderbird"]
    assert st.preference(["b", "a"], ["a", "b", "c"]) == ["b", "a", "c"]
