"""What the brokers without a Spark connector speak: signed AWS calls, Pub/Sub's REST, NATS and AMQP."""

from __future__ import annotations

import base64
import configparser
import hashlib
import hmac
import json
import os
import socket
import ssl
import struct
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path
from typing import Any


class BrokerError(RuntimeError):
    def __init__(self, message: str, kind: str = ""):
        super().__init__(message)
        self.kind = kind


# --- AWS -------------------------------------------------------------------------------------------


def signed(method: str, url: str, headers: dict[str, str], body: bytes, *, key: str, secret: str, token: str | None, region: str, service: str, now: str | None = None) -> dict[str, str]:
    """The headers with a signature of version 4."""
    now = now or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    parts = urllib.parse.urlsplit(url)
    head = {k.lower(): " ".join(v.split()) for k, v in headers.items()} | {"host": parts.netloc, "x-amz-date": now} | ({"x-amz-security-token": token} if token else {})
    names = ";".join(sorted(head))
    query = "&".join(sorted(f"{urllib.parse.quote(k, safe='-_.~')}={urllib.parse.quote(v, safe='-_.~')}" for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True)))
    request = "\n".join([method, urllib.parse.quote(parts.path or "/", safe="/-_.~%"), query, *(f"{k}:{head[k]}" for k in sorted(head)), "", names, hashlib.sha256(body).hexdigest()])
    scope = f"{now[:8]}/{region}/{service}/aws4_request"
    text = "\n".join(["AWS4-HMAC-SHA256", now, scope, hashlib.sha256(request.encode()).hexdigest()])
    k = f"AWS4{secret}".encode()
    for part in (now[:8], region, service, "aws4_request"):
        k = hmac.new(k, part.encode(), hashlib.sha256).digest()
    signature = hmac.new(k, text.encode(), hashlib.sha256).hexdigest()
    return {**headers, **{n: head[n] for n in ("x-amz-date", "x-amz-security-token") if n in head}, "Authorization": f"AWS4-HMAC-SHA256 Credential={key}/{scope}, SignedHeaders={names}, Signature={signature}"}


def aws_settings(p: dict[str, Any]) -> dict[str, str | None]:
    """Key, secret, token and region: the node's own, the environment's, or a profile's."""
    profile = p.get("profile") or os.environ.get("AWS_PROFILE") or "default"
    files = configparser.ConfigParser()
    files.read([os.path.expanduser(os.environ.get("AWS_SHARED_CREDENTIALS_FILE", "~/.aws/credentials")), os.path.expanduser(os.environ.get("AWS_CONFIG_FILE", "~/.aws/config"))])
    own = {k: v for n in (profile, f"profile {profile}") if files.has_section(n) for k, v in files.items(n)}
    env = os.environ if not p.get("profile") else {}
    key = p.get("access_key_id") or env.get("AWS_ACCESS_KEY_ID") or own.get("aws_access_key_id")
    secret = p.get("secret_access_key") or env.get("AWS_SECRET_ACCESS_KEY") or own.get("aws_secret_access_key")
    if not key or not secret:
        raise BrokerError("there are no AWS credentials: set access_key_id and secret_access_key, the environment, or a profile")
    token = p.get("session_token") or (None if p.get("access_key_id") else env.get("AWS_SESSION_TOKEN") or own.get("aws_session_token"))
    return {"key": key, "secret": secret, "token": token, "region": p.get("region") or env.get("AWS_REGION") or env.get("AWS_DEFAULT_REGION") or own.get("region") or "us-east-1"}


def post_json(url: str, headers, body: dict[str, Any], timeout_ms: int, retries: int, again: tuple[str, ...] = ()) -> dict[str, Any]:
    """The answer to a JSON call; throttling, 5xx and network failures are tried again. headers may be a function of the body."""
    raw = json.dumps(body).encode()
    for attempt in range(retries + 1):
        try:
            head = headers(raw) if callable(headers) else headers
            with urllib.request.urlopen(urllib.request.Request(url, raw, head, method="POST"), timeout=timeout_ms / 1000) as reply:
                return json.loads(reply.read() or b"{}")
        except urllib.error.HTTPError as e:
            text = e.read().decode("utf-8", "replace")
            try:
                said = json.loads(text)
            except ValueError:
                said = {}
            kind = str(said.get("__type") or (said.get("error") or {}).get("status") if isinstance(said, dict) else "").rsplit("#", 1)[-1]
            if attempt == retries or not (e.code == 429 or e.code >= 500 or kind in again):
                raise BrokerError(f"{url} answers {e.code} {kind}: {text[:300]}", kind) from None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if attempt == retries:
                raise BrokerError(f"{url}: {e}") from None
        time.sleep(min(0.2 * 2**attempt, 5))
    raise AssertionError


_THROTTLED = ("ThrottlingException", "ProvisionedThroughputExceededException", "RequestThrottled", "LimitExceededException")


def aws_call(p: dict[str, Any], s: dict[str, Any], service: str, target: str, body: dict[str, Any]) -> dict[str, Any]:
    url = (p.get("endpoint") or f"https://{service}.{s['region']}.amazonaws.com").rstrip("/") + "/"
    base = {"Content-Type": f"application/x-amz-json-1.{0 if service == 'sqs' else 1}", "X-Amz-Target": target}
    return post_json(url, lambda raw: signed("POST", url, base, raw, service=service, **s), body, p["timeout_ms"], p["retries"], _THROTTLED)


# --- Pub/Sub ----------------------------------------------------------------------------------------


def google_token(spark, p: dict[str, Any]) -> str | None:
    """A bearer token for the service account of credentials_file, its request signed by Java's RSA. An
    endpoint of one's own needs none."""
    path = p.get("credentials_file") or os.environ.get("GOOGLE_APPLICATION_CREDENTIALS")
    if not path:
        if p.get("endpoint"):
            return None
        raise BrokerError("set credentials_file, GOOGLE_APPLICATION_CREDENTIALS, or an endpoint that needs no credentials")
    account = json.loads(Path(path).read_text())
    now = int(time.time())
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=")
    claim = part({"alg": "RS256", "typ": "JWT"}) + b"." + part({"iss": account["client_email"], "scope": "https://www.googleapis.com/auth/pubsub", "aud": account["token_uri"], "iat": now, "exp": now + 3600})
    jvm = spark._jvm
    der = base64.b64decode("".join(x for x in account["private_key"].splitlines() if "-----" not in x))
    signer = jvm.java.security.Signature.getInstance("SHA256withRSA")
    signer.initSign(jvm.java.security.KeyFactory.getInstance("RSA").generatePrivate(jvm.java.security.spec.PKCS8EncodedKeySpec(der)))
    signer.update(claim)
    assertion = (claim + b"." + base64.urlsafe_b64encode(bytes(signer.sign())).rstrip(b"=")).decode()
    body = urllib.parse.urlencode({"grant_type": "urn:ietf:params:oauth:grant-type:jwt-bearer", "assertion": assertion}).encode()
    with urllib.request.urlopen(account["token_uri"], body, timeout=30) as reply:
        return json.loads(reply.read())["access_token"]


def pubsub_call(p: dict[str, Any], token: str | None, name: str, body: dict[str, Any]) -> dict[str, Any]:
    url = f"{(p.get('endpoint') or 'https://pubsub.googleapis.com').rstrip('/')}/v1/{name}"
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    return post_json(url, head, body, p["timeout_ms"], p["retries"])


# --- lines over TCP ----------------------------------------------------------------------------------


def connect(host: str, port: int, timeout: float, tls: bool, ca_cert: str | None) -> socket.socket:
    s = socket.create_connection((host, port), timeout)
    return ssl.create_default_context(cafile=ca_cert).wrap_socket(s, server_hostname=host) if tls else s


class Nats:
    """A client of NATS with the request and reply that JetStream's API takes."""

    def __init__(self, p: dict[str, Any]):
        url = urllib.parse.urlsplit(p["url"] if "://" in p["url"] else f"nats://{p['url']}")
        self.sock = socket.create_connection((url.hostname, url.port or 4222), p["timeout_ms"] / 1000)
        self.file = self.sock.makefile("rb")
        info = json.loads(self.file.readline().split(None, 1)[1])
        if p["tls"] or url.scheme == "tls" or info.get("tls_required"):
            self.sock = ssl.create_default_context(cafile=p["ca_cert"]).wrap_socket(self.sock, server_hostname=url.hostname)
            self.file = self.sock.makefile("rb")
        options: dict[str, Any] = {"verbose": False, "pedantic": False, "headers": True, "lang": "python", "version": "1"}
        if p["auth"] == "user_password":
            options |= {"user": p["username"], "pass": p["password"]}
        elif p["auth"] == "token":
            options["auth_token"] = p["token"]
        self.inbox = f"_INBOX.{uuid.uuid4().hex}"
        self.send(f"CONNECT {json.dumps(options)}\r\nSUB {self.inbox}.* 1\r\nPING\r\n".encode())
        while not (line := self._line()).startswith(b"PONG"):
            pass
        self.n = 0

    def send(self, data: bytes) -> None:
        self.sock.sendall(data)

    def _line(self) -> bytes:
        line = self.file.readline()
        if not line:
            raise BrokerError("NATS closed the connection")
        if line.startswith(b"-ERR"):
            raise BrokerError(f"NATS says {line[5:].decode().strip()}")
        if line.startswith(b"PING"):
            self.send(b"PONG\r\n")
        return line

    def publish(self, subject: str, data: bytes, headers: dict[str, str] | None = None) -> str:
        """Sends a message and returns where its answer comes to."""
        self.n += 1
        reply = f"{self.inbox}.{self.n}"
        if headers:
            head = b"NATS/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n"
            self.send(f"HPUB {subject} {reply} {len(head)} {len(head) + len(data)}\r\n".encode() + head + data + b"\r\n")
        else:
            self.send(f"PUB {subject} {reply} {len(data)}\r\n".encode() + data + b"\r\n")
        return reply

    def answer(self) -> tuple[str, dict[str, Any]]:
        """The next answer: where it came to, and its JSON."""
        while True:
            line = self._line()
            if line.startswith((b"MSG", b"HMSG")):
                parts = line.split()
                data = self.file.read(int(parts[-1]) + 2)[:-2]
                if line.startswith(b"HMSG"):
                    status = data[: int(parts[-2])].split(b"\r\n")[0]
                    data = data[int(parts[-2]) :]
                    if not data:
                        raise BrokerError(f"NATS answers {status.decode()}: is JetStream on, and does the stream exist?")
                return parts[1].decode(), json.loads(data)

    def ask(self, subject: str, body: dict[str, Any] | None = None) -> dict[str, Any]:
        self.publish(subject, json.dumps(body).encode() if body else b"")
        found = self.answer()[1]
        if found.get("error"):
            raise BrokerError(f"NATS: {found['error'].get('description')}", str(found["error"].get("err_code") or found["error"].get("code")))
        return found

    def close(self) -> None:
        self.sock.close()


# --- AMQP 0-9-1 ---------------------------------------------------------------------------------------


def _short(text: str) -> bytes:
    raw = text.encode()
    return bytes([len(raw)]) + raw


def _long(raw: bytes) -> bytes:
    return struct.pack(">I", len(raw)) + raw


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, form: str) -> Any:
        out = struct.unpack_from(f">{form}", self.data, self.at)[0]
        self.at += struct.calcsize(f">{form}")
        return out

    def raw(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def short(self) -> str:
        return self.raw(self.number("B")).decode()

    def table(self) -> dict[str, Any]:
        end = self.number("I") + self.at
        out = {}
        while self.at < end:
            name = self.short()
            out[name] = self.value()
        return out

    def value(self) -> Any:
        kind = self.raw(1).decode()
        if kind == "S":
            return self.raw(self.number("I")).decode("utf-8", "replace")
        if kind == "F":
            return self.table()
        if kind == "A":
            end, out = self.number("I") + self.at, []
            while self.at < end:
                out.append(self.value())
            return out
        if kind == "D":
            scale = self.number("B")
            return self.number("i") / 10**scale
        if kind == "x":
            return base64.b64encode(self.raw(self.number("I"))).decode()
        if kind == "V":
            return None
        value = self.number({"t": "B", "b": "b", "B": "B", "s": "h", "u": "H", "I": "i", "i": "I", "l": "q", "L": "q", "f": "f", "d": "d", "T": "Q"}[kind])
        return bool(value) if kind == "t" else value


class Amqp:
    """A client of AMQP 0-9-1 with one channel: get, ack, nack, and publishing with confirms."""

    def __init__(self, p: dict[str, Any]):
        url = urllib.parse.urlsplit(p["url"] if "://" in p["url"] else f"amqp://{p['url']}")
        tls = url.scheme == "amqps"
        self.sock = connect(url.hostname, url.port or (5671 if tls else 5672), p["timeout_ms"] / 1000, tls, p["ca_cert"])
        self.file = self.sock.makefile("rb")
        self.sock.sendall(b"AMQP\0\0\x09\x01")
        self._expect(10, 10)
        user = p["username"] or urllib.parse.unquote(url.username or "guest")
        secret = p["password"] or urllib.parse.unquote(url.password or "guest")
        self._send(10, 11, struct.pack(">I", 0) + _short("PLAIN") + _long(f"\0{user}\0{secret}".encode()) + _short("en_US"), channel=0)
        tune = self._expect(10, 30)
        channels, self.frame, _ = tune.number("H"), tune.number("I"), tune.number("H")
        self.frame = self.frame or 131072
        self._send(10, 31, struct.pack(">HIH", channels, self.frame, 0), channel=0)
        vhost = p["vhost"] if p["vhost"] is not None else urllib.parse.unquote(url.path[1:]) if len(url.path) > 1 else "/"
        self._send(10, 40, _short(vhost) + _short("") + b"\0", channel=0)
        self._expect(10, 41)
        self._send(20, 10, _short(""))
        self._expect(20, 11)
        self.published = 0

    def _write(self, kind: int, channel: int, payload: bytes) -> None:
        self.sock.sendall(struct.pack(">BHI", kind, channel, len(payload)) + payload + b"\xce")

    def _send(self, cls: int, method: int, arguments: bytes, channel: int = 1) -> None:
        self._write(1, channel, struct.pack(">HH", cls, method) + arguments)

    def _next(self) -> tuple[int, bytes]:
        while True:
            head = self.file.read(7)
            if len(head) < 7:
                raise BrokerError("the broker closed the connection")
            kind, _, size = struct.unpack(">BHI", head)
            payload = self.file.read(size + 1)[:-1]
            if kind != 8:  # a heartbeat
                return kind, payload

    def _method(self) -> tuple[tuple[int, int], _Reader]:
        _, payload = self._next()
        r = _Reader(payload)
        found = r.number("H"), r.number("H")
        if found in ((10, 50), (20, 40)):
            code, text = r.number("H"), r.short()
            raise BrokerError(f"the broker says {code}: {text}", str(code))
        return found, r

    def _expect(self, cls: int, method: int) -> _Reader:
        found, r = self._method()
        if found != (cls, method):
            raise BrokerError(f"the broker sends {found}, not {(cls, method)}")
        return r

    def _content(self) -> tuple[dict[str, Any], bytes]:
        r = _Reader(self._next()[1])
        r.number("H"), r.number("H")
        size, flags = r.number("Q"), r.number("H")
        props: dict[str, Any] = {}
        for bit, name, read in ((15, "content_type", r.short), (14, "content_encoding", r.short), (13, "headers", r.table), (12, "delivery_mode", lambda: r.number("B")), (11, "priority", lambda: r.number("B")), (10, "correlation_id", r.short), (9, "reply_to", r.short), (8, "expiration", r.short), (7, "message_id", r.short), (6, "timestamp", lambda: r.number("Q"))):
            if flags >> bit & 1:
                props[name] = read()
        body = b""
        while len(body) < size:
            body += self._next()[1]
        return props, body

    def get(self, queue: str) -> dict[str, Any] | None:
        """The next message, held until it is acknowledged, or none."""
        self._send(60, 70, struct.pack(">H", 0) + _short(queue) + b"\0")
        found, r = self._method()
        if found == (60, 72):
            return None
        tag, again, exchange, key = r.number("Q"), r.number("B"), r.short(), r.short()
        props, body = self._content()
        return {"tag": tag, "redelivered": bool(again), "exchange": exchange, "routing_key": key, "body": body, **props}

    def settle(self, tag: int, ack: bool) -> None:
        """Acknowledges all messages up to the tag, or gives them back to the queue."""
        self._send(*((60, 80, struct.pack(">QB", tag, 1)) if ack else (60, 120, struct.pack(">QB", tag, 3))))

    def confirm(self) -> None:
        self._send(85, 10, b"\0")
        self._expect(85, 11)

    def publish(self, exchange: str, key: str, body: bytes, persistent: bool) -> None:
        self._send(60, 40, struct.pack(">H", 0) + _short(exchange) + _short(key) + b"\1")
        self._write(2, 1, struct.pack(">HHQH", 60, 0, len(body), 1 << 15 | 1 << 12) + _short("application/json") + bytes([2 if persistent else 1]))
        for at in range(0, len(body), self.frame - 8):
            self._write(3, 1, body[at : at + self.frame - 8])
        self.published += 1

    def confirmed(self) -> None:
        """Waits until the broker has taken everything published; a message that no queue takes is an error."""
        done = 0
        while done < self.published:
            found, r = self._method()
            if found == (60, 50):
                _, text, exchange, key = r.number("H"), r.short(), r.short(), r.short()
                self._content()
                raise BrokerError(f"no queue takes messages for '{key}' of exchange '{exchange}': {text}")
            if found == (60, 120):
                raise BrokerError("the broker refuses a message")
            if found == (60, 80):
                done = r.number("Q")

    def close(self) -> None:
        try:
            self._send(10, 50, struct.pack(">H", 200) + _short("bye") + struct.pack(">HH", 0, 0), channel=0)
        finally:
            self.sock.close()


def batches(items: Iterator[Any], count: int, size: int = 1 << 62, weigh=len) -> Iterator[list[Any]]:
    """Lists of up to `count` items and `size` bytes."""
    held: list[Any] = []
    total = 0
    for x in items:
        n = weigh(x)
        if held and (len(held) == count or total + n > size):
            yield held
            held, total = [], 0
        held.append(x)
        total += n
    if held:
        yield held
