"""Keys in the encodings that texts hold them in: wrapped, escaped, with headers, after a path."""

import base64
import os
import re

import pytest
from trackloom.llm import secrets


def der(*lengths):
    ints = b"\x02\x01\x00" + b"".join(b"\x02" + (bytes([n]) if n < 128 else b"\x81" + bytes([n])) + b"\x11" * n for n in lengths)
    return b"\x30" + (b"\x81" + bytes([len(ints)]) if len(ints) < 256 else b"\x82" + len(ints).to_bytes(2, "big")) + ints


RSA = der(65, 3, 64, 33, 33, 33, 33, 33)
DSA = der(65, 21, 64, 64, 20)
B = base64.b64encode(RSA).decode()
LINES = re.findall(".{1,64}", B)


def pem(break_, head="", body=LINES):
    return f"-----BEGIN RSA PRIVATE KEY-----{break_}{head}{break_.join(body)}{break_}-----END RSA PRIVATE KEY-----"


LOCKED = re.findall(".{1,64}", base64.b64encode(os.urandom(304)).decode())
HEAD = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"


@pytest.mark.parametrize(
    "secret, kind",
    [
        (pem("\n"), "pem"), (pem("\r\n"), "pem"), (pem("\\n"), "pem"), (pem("\\\\n"), "pem"), (pem("\\r\\n"), "pem"), (pem("\n", HEAD, LOCKED), "pem"),
        (pem("\\n", HEAD.replace("\n", "\\n"), LOCKED), "pem"), ("\n".join(LINES), "der"), ("\\n".join(LINES), "der"), ("\n  ".join(LINES), "der"),
        (base64.b64encode(DSA).decode(), "der"), (base64.b64encode("Grüße secret = abcdefghijklmnop".encode()).decode(), "encoded"),
    ],
)
def test_encoding(secret, kind):
    text = f'x é "{secret}" y'
    found = [(s, e) for s, k, e in secrets.spans(text) if secrets.KINDS[k] == kind]
    assert (5, 5 + len(secret)) in found, (found, len(secret))


def test_inside_a_run():
    for before in ("/keys/", "a-b-", "/keys/x/", "abc"):
        text = f"x {before}{B} y"
        assert (2 + len(before), 5, 2 + len(before) + len(B)) in secrets.spans(text), before


def test_not_keys():
    bad = [pem("\n", body=LINES[:-1]), "\n".join(LINES[:-1]), "\\n".join(LINES[1:]), f"/keys/{B[:-8]}", pem("\n", HEAD, LOCKED[:-1] + ["abcd"])]
    assert not [k for t in bad for _, k, _ in secrets.spans(t) if k in (4, 5)]
