"""Pure predicates and digests around sign-in."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def email_domain(email: Column) -> Column:
    clean = F.lower(F.trim(email))
    return F.when(clean.contains("@"), F.substring_index(clean, "@", -1)).otherwise("")


def is_allowed(email: Column, hosted: Column, domains: list[str], emails: list[str]) -> Column:
    """An address on the list, or one whose domain is allowed and equals the hosted-domain claim."""
    clean = F.lower(F.trim(email))
    domain = email_domain(email)
    by_domain = (domain != "") & domain.isin([d.lower() for d in domains]) & (F.lower(F.coalesce(hosted, F.lit(""))) == domain)
    return F.coalesce(clean.isin([e.lower() for e in emails]) | by_domain, F.lit(False))


def hmac_sha256(secret: str, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256, from two sha2 calls over the padded key."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.sha2(F.concat(pad(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def user_hash(secret: str, email: Column) -> Column:
    return F.substring(hmac_sha256(secret, F.lower(F.trim(email))), 1, 16)


def pkce_challenge(verifier: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(verifier.cast("binary"), 256))), "+/", "-_"), F.lit("="))


CLAIMS = "iss string, aud string, exp long, nonce string, email string, email_verified boolean, hd string"


def decode_claims(token: Column) -> Column:
    """The payload of a JWT as struct CLAIMS; null if it is no JWT. The signature is not checked here."""
    part = F.translate(F.get(F.split(token, r"\."), F.lit(1)), "-_", "+/")
    padded = F.rpad(part, (F.ceil(F.length(part) / 4) * 4).cast("int"), "=")
    return F.from_json(F.call_function("try_to_binary", padded, F.lit("base64")).cast("string"), CLAIMS)


def claims_hold(claims: Column, issuers: list[str], audience: str, nonce: str, now: Column, skew: int = 60) -> Column:
    """Issuer, audience (text or list), expiry with skew, nonce and verified address."""
    aud = F.coalesce(F.from_json(F.when(claims["aud"].startswith("["), claims["aud"]), "array<string>"), F.array(claims["aud"]))
    return F.coalesce(
        claims["iss"].isin(issuers) & F.array_contains(aud, audience) & (claims["exp"] + skew > now) & (claims["nonce"] == nonce) & claims["email_verified"],
        F.lit(False),
    )
