"""Where candidates for secrets lie, and that long texts without white space take time in proportion."""

import time

import pytest

from chatspark.llm import secrets


def found(text):
    return [text[a:b] for a, b in secrets.places(text)]


@pytest.mark.parametrize("text,values", [
    ("/login?password=hunter2abc&user=bob&lang=en", ["hunter2abc"]),
    ("password=x1y2;token=abc99,secret=q7", ["x1y2", "abc99", "q7"]),
    ("postgres://u:S3cr3tPw@db/x", ["S3cr3tPw"]),
    ("see https://host:80/a and ftp://me@host", []),
    ('api_key: "with space, and; marks"', ["with space, and; marks"]),
    ("key=akey=btoken=c", ["a", "b", "c"]),
    ("DB_PASSWORD=p4ss", ["p4ss"]),
    ("", []),
])
def test_extents(text, values):
    assert found(text) == values


@pytest.mark.parametrize("unit", ["key=a1b2c3d4&", "key=a1b2", "a=", "token:", "secret", "x", "://a:b", "key='", 'key="a ', "A1=b2=c3", "password is "])
def test_time_grows_with_the_text(unit):
    def took(n):
        text = unit * (n // len(unit))
        began = time.process_time()
        spans = secrets.places(text)
        assert sum(b - a for a, b in spans) <= 30 * len(text) + 100
        return time.process_time() - began

    took(1000)
    small, large = min(took(50_000) for _ in range(2)), took(400_000)
    assert large < max(1.0, 24 * small)
    assert large < 6
