"""Small WARC files written for the tests."""

import gzip
import uuid
import zipfile


def record(kind, uri, body, date="2024-01-02T03:04:05Z", length=True, extra="", gap=b"\r\n\r\n", newline="\r\n"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, uri + kind + date)}>", f"WARC-Date: {date}"]
    if uri:
        head.append(f"WARC-Target-URI: <{uri}>")
    if length:
        head.append(f"Content-Length: {len(body)}")
    if extra:
        head.append(extra)
    return newline.join(head).encode() + (newline * 2).encode() + body + gap


def http(body, status="200 OK", headers=("Content-Type: text/html; charset=utf-8",)):
    return f"HTTP/1.1 {status}\r\n".encode() + "".join(h + "\r\n" for h in headers).encode() + b"\r\n" + body


def chunked(*parts):
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def records(n=40, gap=b"\r\n\r\n"):
    out = [record("warcinfo", "", b"software: test\r\n", gap=gap)]
    for i in range(n):
        uri = f"https://site.test/page/{i}"
        if i % 5 == 3:
            out.append(record("request", uri, b"GET / HTTP/1.1\r\nHost: site.test\r\n\r\n", gap=gap))
        body = (b"<p>page %d</p>" % i) * (1 + i * 7 % 50)
        if i % 4 == 1:
            out.append(record("response", uri, http(chunked(body[:9], body[9:]), headers=("Transfer-Encoding: gzip, chunked", "X-A: 1", "x-a: 2")), gap=gap))
        else:
            out.append(record("response", uri, http(body), gap=gap))
    return out


def write(path, parts):
    path.write_bytes(b"".join(parts))
    return str(path)


def write_gz(path, parts):
    path.write_bytes(b"".join(gzip.compress(p) for p in parts))
    return str(path)


def write_wacz(path, parts, method=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr(zipfile.ZipInfo("archive/data.warc.gz"), b"".join(gzip.compress(p) for p in parts), method)
        z.writestr(zipfile.ZipInfo("indexes/index.cdx"), "a b c\n", zipfile.ZIP_STORED)
    return str(path)
