"""String, hash, URL and token functions as columns, all built-in expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- hashes -----------------------------------------------------------------------------------------------------------


def sha256_hex(x) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes, or of a binary."""
    return F.sha2(_c(x).cast("binary"), 256)


def hmac_sha256_hex(key: bytes, message) -> Column:
    """Lower-case hex HMAC-SHA256 with a constant key: both pads are literals, so no user function is needed."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)).cast("binary") for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, _c(message).cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def base64url(x) -> Column:
    """URL-safe base64 without padding, of a binary."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(_c(x)), r"\s", ""), "+/", "-_"), F.lit("="))


def unbase64url(x) -> Column:
    """The bytes of URL-safe base64 without padding."""
    x = F.translate(_c(x), "-_", "+/")
    return F.unbase64(F.concat(x, F.repeat(F.lit("="), F.pmod(-F.length(x), F.lit(4)))))


def pkce_challenge(verifier) -> Column:
    """The S256 challenge of a verifier, null for one whose length or characters are not allowed."""
    valid = _c(verifier).rlike(r"^[A-Za-z0-9._~-]{43,128}$")
    return F.when(valid, base64url(F.unhex(sha256_hex(verifier))))


def handle_hash(secret: bytes, handle) -> Column:
    return hmac_sha256_hex(secret, unicode_trim(handle))


def csrf_token(secret: bytes, rotation, origin, prefix: str = "csrf-v1:") -> Column:
    """Both parts are trimmed, and the origin's last slashes go."""
    return hmac_sha256_hex(secret, F.concat(F.lit(prefix), unicode_trim(rotation), F.lit(":"), F.rtrim(unicode_trim(origin), F.lit("/"))))


def same_secret(a, b) -> Column:
    """Whether two secrets are equal, by their digests: how long it takes tells nothing of where they differ."""
    return sha256_hex(a) == sha256_hex(b)


# --- names and ids ----------------------------------------------------------------------------------------------------


def unicode_trim(x) -> Column:
    """Without Unicode white space at both ends (``F.trim`` strips spaces only)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def slug_error(x) -> Column:
    """Why a slug is not valid, or null: trimmed, not empty, and only a-z, 0-9, '-' and '_'."""
    trimmed = unicode_trim(x)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "empty").when(~trimmed.rlike(r"^[a-z0-9_-]+$"), "bad_character")


def strict_slug(x) -> Column:
    """The stricter rule of forms: words of a-z and 0-9 joined by single hyphens."""
    return F.coalesce(_c(x).rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


def slugify(x) -> Column:
    """A slug made of a name: other characters become hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(_c(x))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def typed_slug(x) -> Column:
    """What stays of a slug while it is typed."""
    return F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9-]", "")


def capability(x) -> Column:
    """The canonical name of a capability, null if empty or with a character that is not allowed."""
    name = F.upper(unicode_trim(x))
    return F.when(name.rlike(r"^[A-Z0-9_:-]+$"), name)


def one_of(x, allowed: tuple[str, ...]) -> Column:
    """The lower-case member of a closed set, null for anything else, white space around it included."""
    value = F.lower(_c(x))
    return F.when(value.isin(*allowed), value)


def correlation_id(x, longest: int = 128) -> Column:
    """A trimmed id if it is safe to log, else null."""
    value = unicode_trim(x)
    return F.when((F.octet_length(value) <= longest) & value.rlike(r"^[A-Za-z0-9._:-]+$"), value)


def pick_correlation_id(correlation, request, generated) -> Column:
    """The first safe one of the two headers, else the generated id."""
    return F.coalesce(correlation_id(correlation), correlation_id(request), _c(generated))


# --- redaction --------------------------------------------------------------------------------------------------------

#: Parts of names of sensitive fields; fixed values.
SENSITIVE = (
    "authorization", "cookie", "set-cookie", "token", "access_token", "refresh_token", "id_token", "secret", "client_secret", "password",
    "passwd", "api_key", "api-key", "apikey", "private_key", "credential", "cui", "document_text", "prompt", "payload",
)
REDACTED = "[REDACTED]"


def sensitive_key(x) -> Column:
    """Whether a field's name has a sensitive part; hyphens count as underscores."""
    name = F.replace(F.lower(_c(x)), F.lit("-"), F.lit("_"))
    return name.rlike("|".join(sorted({p.replace("-", "_") for p in SENSITIVE})))


def redacted(key, value) -> Column:
    return F.when(sensitive_key(key), REDACTED).otherwise(_c(value))


def redacted_map(headers) -> Column:
    return F.transform_values(_c(headers), lambda k, v: redacted(k, v))


def masked_url(x) -> Column:
    """A connection URL with its password hidden, its scheme in lower case.

    The password goes from the first colon of the user part to the last @ before the path. If a password holds a
    character that should have been escaped, all goes up to the first @ of the URL.
    """
    shown = F.regexp_replace(_c(x), r"^([A-Za-z][A-Za-z0-9+.-]*://[^:/?#@]*):(?:[^/?#]*@|[^@]*@)", "$1:***@")
    scheme = F.regexp_extract(shown, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.concat(F.lower(scheme), F.substring(shown, F.length(scheme) + 1, F.length(shown)))


# --- requests and tokens ----------------------------------------------------------------------------------------------

#: Ports that an origin leaves out; fixed values.
DEFAULT_PORTS = ("http:80", "https:443", "ws:80", "wss:443", "ftp:21")


def canonical_origin(x) -> Column:
    """scheme://host[:port] in lower case without a default port; null for what is no origin."""
    text = unicode_trim(x)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    whole = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)(?::([0-9]*))?(?=[/?#]|$)"  # a host may be an IPv6 address
    host = F.lower(F.regexp_extract(text, whole, 1))
    number = F.regexp_extract(text, whole, 2).try_cast("int")
    port = F.coalesce(number.cast("string"), F.lit(""))
    plain = (port == "") | F.concat(scheme, F.lit(":"), port).isin(*DEFAULT_PORTS)
    fits = F.coalesce(number <= 65535, F.regexp_extract(text, whole, 2) == "")
    return F.when((scheme != "") & (host != "") & fits, F.concat(scheme, F.lit("://"), host, F.when(plain, "").otherwise(F.concat(F.lit(":"), port))))


def csrf_decision(method, by_cookie, origin, header, allowed: tuple[str, ...], expected) -> Column:
    """The first matching outcome for a request: exempt, a missing or wrong origin, a missing or wrong token, ok.

    Origins are compared in canonical form, those that are allowed as well.
    """
    known = F.array_compact(F.array(*(canonical_origin(F.lit(a)) for a in allowed)).cast("array<string>"))
    found, header = canonical_origin(origin), unicode_trim(header)
    return (
        F.when(F.upper(_c(method)).isin("GET", "HEAD", "OPTIONS", "TRACE"), "safe_method").when(~_c(by_cookie), "no_cookie")
        .when(_c(origin).isNull(), "origin_missing").when(found.isNull() | ~F.array_contains(known, found), "origin_mismatch")
        .when(F.coalesce(header, F.lit("")) == "", "header_missing").when(_c(expected).isNotNull() & (header != F.trim(_c(expected))), "token_mismatch")
        .otherwise("ok")
    )


def cookie_value(header, name: str) -> Column:
    """The first non-blank value of a cookie in a Cookie header."""
    parts = F.transform(F.split(_c(header), ";"), lambda p: F.trim(p))
    own = F.filter(parts, lambda p: p.startswith(f"{name}=") & (F.trim(F.substring(p, len(name) + 2, 1 << 30)) != ""))
    return F.trim(F.substring(F.get(own, 0), len(name) + 2, 1 << 30))


def jwt_claim(token, claim: str) -> Column:
    """A claim of a token's payload, unverified; null where the payload cannot be read."""
    return F.get_json_object(unbase64url(F.get(F.split(_c(token), r"\."), 1)).cast("string"), f"$.{claim}")


#: Signature algorithms by class; fixed values.
ASYMMETRIC, SYMMETRIC = ("RS256", "RS384", "RS512", "ES256", "ES384", "EdDSA"), ("HS256", "HS384", "HS512")


def algorithm_decision(alg) -> Column:
    return F.when(_c(alg).isin(*ASYMMETRIC), "ok").when(_c(alg).isin(*SYMMETRIC), "symmetric_rejected").otherwise("not_allowed")


def jwk_decision(kty, n, e, x, y) -> Column:
    """Whether a key has the members that its type needs."""
    need = lambda *members: F.when(F.greatest(*(_c(m).isNull() for m in members)) if len(members) > 1 else _c(members[0]).isNull(), "member_missing").otherwise("ok")
    kty = _c(kty)
    return (
        F.when(kty == "RSA", need(n, e)).when(kty == "EC", need(x, y)).when(kty == "OKP", need(x)).when(kty == "oct", "symmetric_rejected").otherwise("not_allowed")
    )


def authorization_url(endpoint, pairs: list[tuple[str, Column]]) -> Column:
    """An endpoint with URL-encoded query pairs, in the given order."""
    return F.concat(_c(endpoint), F.lit("?"), F.array_join(F.array(*(F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in pairs)), "&"))


def key_cache_decision(now, fetched, attempted, found, ttl: int = 3600, pause: int = 10) -> Column:
    """What a key lookup does (times in epoch seconds): use a fresh hit; within the pause use a stale one; or refresh."""
    now, fetched, attempted, found = map(_c, (now, fetched, attempted, found))
    fresh = fetched.isNotNull() & (now - fetched < ttl)
    return (
        F.when(fresh & found, "use").when(attempted.isNotNull() & (now - attempted < pause), F.when(found, "use_stale").otherwise("not_found")).otherwise("refresh")
    )


#: Names of environments, and severities and problems by status; fixed values.
ENVIRONMENTS = {
    "development": "development", "dev": "development", "local": "development", "test": "test", "testing": "test", "staging": "staging",
    "stage": "staging", "production": "production", "prod": "production",
}
PROBLEMS = {
    401: ("unauthorized", "Unauthorized", "UNAUTHORIZED"), 403: ("forbidden", "Forbidden", "FORBIDDEN"), 404: ("not-found", "Not Found", "NOT_FOUND"),
    409: ("conflict", "Conflict", "CONFLICT"),
}


def mapped(x, values: dict[str, str], other: Column | None = None) -> Column:
    """The value of a key in a small constant map, else ``other``."""
    pairs = [F.lit(v) for pair in values.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(x)), other if other is not None else F.lit(None).cast("string"))


def environment(x) -> Column:
    """A server's environment by name or alias; null if unknown."""
    return mapped(F.lower(unicode_trim(x)), ENVIRONMENTS)


#: Names that a web client knows, with the labels that it shows; fixed values.
WEB_LABELS = {
    "local": "LOCAL [NON-PROD]", "dev": "DEV [NON-PROD]", "demo": "DEMO [NON-PROD]", "staging": "STAGING [NON-PROD]", "public-demo": "PUBLIC DEMO [NON-PROD]", "production": "PRODUCTION",
}


def web_environment(x) -> list[Column]:
    """A web client's environment: name ('local' for what it does not know), label, is_production."""
    given = unicode_trim(F.lower(F.coalesce(F.nullif(_c(x), F.lit("")), F.lit("local"))))
    name = F.when(given.isin(*WEB_LABELS), given).otherwise("local")
    return [name.alias("name"), mapped(name, WEB_LABELS).alias("label"), (name == "production").alias("is_production")]


def severity(status) -> Column:
    return F.when(_c(status).isin(401, 403, 409), "warning").when(_c(status) == 404, "info").otherwise("error")


def problem_code(status) -> Column:
    return problem(status, F.lit(""))["code"]


def problem(status, text) -> Column:
    """The problem (kind, title, code) that stands for a failed response without one; ``text`` is its status text."""
    status = _c(status)
    row = lambda kind, title, code: F.struct(F.lit(kind).alias("kind"), (F.lit(title) if isinstance(title, str) else title).alias("title"), F.lit(code).alias("code"))
    out = F.when((status >= 400) & (status < 500) & ~status.isin(*PROBLEMS), row("bad-request", F.coalesce(F.nullif(_c(text), F.lit("")), F.lit("Bad Request")), "BAD_REQUEST"))
    for number, of in PROBLEMS.items():
        out = out.when(status == number, row(*of))
    return out.otherwise(row("internal-error", "Internal Server Error", "INTERNAL_SERVER_ERROR"))


def name_error(x) -> Column:
    """A required name that is missing, or null."""
    return F.when(unicode_trim(F.coalesce(_c(x), F.lit(""))) == "", "required")
