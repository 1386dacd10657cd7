import io
import urllib.error

import pytest

from recordlake.operators import casefacts
from recordlake.sources import http


class Reply(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False


def test_retries_then_succeeds():
    tries, waits = [], []

    def opener(url, timeout):
        tries.append(url)
        if len(tries) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {"Retry-After": "90"} if len(tries) == 1 else {}, None)
        return Reply(b"ok")

    assert http.fetch("http://x", opener=opener, sleep=waits.append) == b"ok"
    assert waits == [30.0, 2.0]


def test_gives_up():
    def gone(url, timeout):
        raise urllib.error.HTTPError(url, 404, "gone", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        http.fetch("http://x", opener=gone, sleep=lambda s: None)
    with pytest.raises(ValueError):
        http.first_good([])

    def get(u):
        if u == "a":
            raise OSError("no")
        return u.encode()

    assert http.first_good(["a", "", "b"], get) == b"b"


def test_manifest_errors():
    ok = {"schema_version": 4, "rule_version": "1.2.3", "source_snapshot_id": "a" * 40}
    assert casefacts.manifest_error(ok) == ""
    assert casefacts.manifest_error(None) == "manifest_invalid"
    assert casefacts.manifest_error(ok | {"schema_version": 3}) == "manifest_schema_incompatible"
    assert casefacts.manifest_error(ok | {"rule_version": "x"}) == "manifest_rule_version_invalid"
    assert casefacts.manifest_error(ok | {"source_snapshot_id": "x"}) == "manifest_source_snapshot_invalid"


def test_manifest_codes_and_messages():
    good = {"schema_version": 2, "shard_pattern": "p", "hash_algorithm": "sha256", "rule_id": "r"}
    check = lambda **k: casefacts.manifest_error(good | k, pattern="p", rule="r", algorithm="sha256")
    assert check() == "" and check(hash_algorithm="md5") == "manifest_layout_incompatible"
    assert casefacts.manifest_message(check(schema_version=9), 9) == "Judgment data error: manifest schema 9 is incompatible with this viewer."
    assert casefacts.manifest_message(check(rule_id="x")).endswith("incompatible extraction rule.") and casefacts.manifest_message("") == ""
