"""Security evidence to verdicts, and evidence from bytecode, templates and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a check by category, first match decides.
CATEGORIES = {
    "contract": ("PROXY", "BYTECODE", "DELEGATE", "TEMPLATE"),
    "mechanics": ("TAX", "MINT", "BLACKLIST", "MAX_", "HOOK", "TOKEN2022", "NON_TRANSFERABLE"),
    "privilege": ("OWNER", "ROLE", "AUTHORITY", "PRIVILEGE", "UPGRADE", "ADMIN"),
    "sell": ("SELL", "HONEYPOT"),
    "liquidity": ("LIQ", "POOL", "GAP"),
}
BANDS = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
SEVERITY = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
#: What a status of the checks SELLABILITY and HONEYPOT_SIM says; others leave it UNKNOWN.
SELLABILITY = {"PASS": "SELLABLE", "FAIL": "NOT_SELLABLE", "NOT_APPLICABLE": "NOT_APPLICABLE", "PROVIDER_LIMITED": "PROVIDER_LIMITED"}
HONEYPOT = {"FAIL": "HONEYPOT", "PASS": "NOT_HONEYPOT", "WARN": "CONDITIONAL", "UNKNOWN": "SIMULATION_FAILED", "PROVIDER_LIMITED": "SIMULATION_FAILED"}
MISSING = ("UNKNOWN", "UNKNOWN_HISTORICAL_STATE", "PROVIDER_LIMITED")
#: Public four-byte selectors and what they let an owner do.
SELECTORS = {
    "40c10f19": "MINT", "8da5cb5b": "OWNER", "f2fde38b": "TRANSFER_OWNERSHIP", "715018a6": "RENOUNCE_OWNERSHIP", "8456cb59": "PAUSE", "3f4ba83a": "UNPAUSE",
    "3659cfe6": "UPGRADE_TO", "4f1ef286": "UPGRADE_TO_AND_CALL", "5c60da1b": "IMPLEMENTATION", "f851a440": "ADMIN", "2f2ff15d": "GRANT_ROLE", "d547741f": "REVOKE_ROLE",
}
#: Severities of these that aren't MEDIUM.
SELECTOR_SEVERITY = {"MINT": "CRITICAL", "UPGRADE_TO": "CRITICAL", "UPGRADE_TO_AND_CALL": "CRITICAL", "PAUSE": "HIGH", "UNPAUSE": "HIGH"}
#: Selectors by the kind of control they give, and the evidence of each kind as (check, severity).
KINDS = {
    "owner": ("8da5cb5b", "f2fde38b", "715018a6"), "mint": ("40c10f19",), "burn": ("42966c68",), "pause": ("8456cb59", "3f4ba83a"), "blacklist": ("f9f92be4", "153b0d1e"),
    "trading": ("8a8c523c", "c9567bf9"), "tax": ("2e5bb6ff", "0b78f9c0", "dc1052e2", "8cd09d50"), "max": ("bc337182", "5d0044ca"), "fees": ("c0246668",), "router": ("c0d78655",), "pair": ("8187f516",),
    "upgrade": ("3659cfe6", "4f1ef286"), "role": ("2f2ff15d", "d547741f", "91d14854"),
}
KIND_EVIDENCE = {
    "owner": ("EVM_OWNER_SELECTOR", "MEDIUM"), "mint": ("EVM_MINT_BACKDOOR", "CRITICAL"), "blacklist": ("EVM_BLACKLIST", "CRITICAL"), "tax": ("EVM_MUTABLE_TAX", "HIGH"), "max": ("EVM_MAX_TX_WALLET", "HIGH"),
    "pause": ("EVM_PAUSE", "HIGH"), "upgrade": ("EVM_UPGRADER_ROLE", "CRITICAL"), "role": ("EVM_ACCESSCONTROL", "MEDIUM"),
}
#: Further selectors as (selector, label, status, severity, rejects).  Those with
#: status INFO are no risk by themselves and don't change a verdict.
MORE_SELECTORS = (
    ("f9f92be4", "BLACKLIST", "FAIL", "CRITICAL", True), ("153b0d1e", "SET_BLACKLIST", "FAIL", "CRITICAL", True),
    ("2e5bb6ff", "SET_TAX", "WARN", "HIGH", False), ("0b78f9c0", "SET_FEES_TAX", "WARN", "HIGH", False), ("dc1052e2", "SET_BUY_TAX", "WARN", "HIGH", False), ("8cd09d50", "SET_SELL_TAX", "WARN", "HIGH", False),
    ("bc337182", "SET_MAX_TX", "WARN", "HIGH", False), ("5d0044ca", "SET_MAX_WALLET", "WARN", "HIGH", False), ("91d14854", "HAS_ROLE", "WARN", "MEDIUM", False),
    ("42966c68", "BURN", "INFO", "INFO", False), ("8a8c523c", "ENABLE_TRADING", "INFO", "INFO", False), ("c9567bf9", "OPEN_TRADING", "INFO", "INFO", False),
    ("c0246668", "EXCLUDE_FROM_FEES", "INFO", "INFO", False), ("c0d78655", "SET_ROUTER", "INFO", "INFO", False), ("8187f516", "SET_PAIR", "INFO", "INFO", False),
)
#: Fixed value: the code around an EIP-1167 clone's target.
CLONE = "363d3d373d3d3d363d73[0-9a-f]{40}5af43d82803e903d91602b57fd5bf3"
UUPS = "52d1902d"


def category(check: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(CATEGORIES.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | check.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def assess(evidence: DataFrame) -> DataFrame:
    """One verdict per token from rows (token, check, status, severity, hard_reject, details).

    REJECT > UNKNOWN or WARN > WARN > PASS; what is unknown never passes.  Of several sellability or honeypot
    rows the last by ``seq`` counts if there is such a column, else the last status by name.
    """
    named = lambda names, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), F.lit("UNKNOWN")).alias(c)
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), "severity"), F.lit(0))
    e = evidence.withColumn("__c", category(F.col("check"))).withColumn("__r", rank).withColumn("__t", F.concat_ws(": ", "check", "details"))
    warn = (F.col("status") == "WARN") & ~F.col("hard_reject")
    place = F.struct("seq", "status") if "seq" in evidence.columns else F.col("status")
    last = lambda check: F.max_by("status", F.when(F.col("check") == check, place))
    out = e.groupBy("token").agg(
        *(F.coalesce(F.max(F.when(F.col("__c") == c, F.col("__r"))), F.lit(0)).alias(c) for c in CATEGORIES),
        F.array_sort(F.collect_list(F.when(F.col("hard_reject"), F.col("__t")))).alias("rejects"), F.array_sort(F.collect_list(F.when(warn, F.col("__t")))).alias("warnings"),
        F.max(F.col("status").isin(*MISSING)).alias("__u"), *(last(check).alias(check.lower()) for check in ("SELLABILITY", "HONEYPOT_SIM")),
    )
    high = (F.col("mechanics") == 3) | (F.col("privilege") == 3) | (F.col("contract") == 3)
    warned = F.size("warnings") > 0
    verdict = F.when(F.size("rejects") > 0, "REJECT").when(F.col("__u"), F.when(warned, "WARN").otherwise("UNKNOWN")).when(warned | high, "WARN").otherwise("PASS")
    band = lambda c: F.get(F.array(*map(F.lit, BANDS)), F.col(c)).alias(f"{c}_risk")
    return out.select("token", verdict.alias("verdict"), *(band(c) for c in CATEGORIES), "rejects", "warnings", named(SELLABILITY, "sellability"), named(HONEYPOT, "honeypot_sim").alias("honeypot"))


def selector_evidence(bytecode: DataFrame, selectors: dict[str, str] = SELECTORS, more: tuple = MORE_SELECTORS, reject_mint: bool = True) -> DataFrame:
    """(token, check, status, severity, hard_reject, details) for each PUSH4 of a known selector, at whole bytes.

    ``reject_mint``: policy on an open mint; a blacklist always rejects.
    """
    known = []
    for sel, label in selectors.items():
        reject = reject_mint and label == "MINT"
        known.append((sel, label, "FAIL" if reject else "WARN", SELECTOR_SEVERITY.get(label, "MEDIUM"), reject))
    rows = bytecode.sparkSession.createDataFrame([*known, *more], "sel string, label string, status string, severity string, hard_reject boolean")
    code = bytecode.select("token", F.lower(F.regexp_replace("code", "^0[xX]", "")).alias("code"))
    at = F.expr("regexp_like(code, concat('^(..)*?63', sel))")
    hit = code.join(F.broadcast(rows), at)
    return hit.select("token", F.concat(F.lit("PRIVILEGE_"), "label").alias("check"), "status", "severity", "hard_reject", F.col("sel").alias("details"))


def privilege_evidence(bytecode: DataFrame, reject_mint: bool = True) -> DataFrame:
    """(token, check, status, severity, hard_reject, details): one row for each kind of control that the code (token, code) has.

    An owner beside a way to change taxes, supply, lists or code is a risk of its own: giving the ownership up may be
    a pretence.  Code without any known selector says so.  The code is read once for each kind.
    """
    code = F.lower(F.regexp_replace("code", "^0[xX]", ""))
    has = bytecode.select("token", *(F.regexp_like(code, F.lit(f"^(..)*?63({'|'.join(sel)})")).alias(kind) for kind, sel in KINDS.items()))
    row = lambda check, status, severity, reject, details: F.struct(*(F.lit(x).alias(k) for k, x in zip(("check", "status", "severity", "hard_reject", "details"), (check, status, severity, reject, details))))
    rows = [F.when(F.col(kind), row(check, "FOUND", severity, kind == "blacklist" or kind == "mint" and reject_mint, kind)) for kind, (check, severity) in KIND_EVIDENCE.items()]
    rows.append(F.when(F.col("owner") & (F.col("tax") | F.col("mint") | F.col("blacklist") | F.col("upgrade")), row("EVM_FAKE_RENOUNCE_RISK", "FOUND", "HIGH", False, "owner and mutators")))
    rows.append(F.when(~F.greatest(*KINDS), row("EVM_PRIVILEGE_SELECTORS", "NOT_FOUND", "INFO", False, "no known selector")))
    return has.select("token", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("token", "r.*")


def template_evidence(tokens: DataFrame, registry: DataFrame) -> DataFrame:
    """Code hashes (token, factory, code_hash) against the known template of the factory (factory, template_hash)."""
    j = tokens.join(registry, "factory", "left")
    status = F.when(F.col("code_hash").isNull(), "UNKNOWN").when(F.col("template_hash").isNull(), "UNKNOWN").when(F.col("code_hash") == F.col("template_hash"), "PASS").otherwise("WARN")
    severity = F.when(status == "WARN", "HIGH").otherwise("INFO")
    return j.select("token", F.lit("TEMPLATE_MATCH").alias("check"), status.alias("status"), severity.alias("severity"), F.lit(False).alias("hard_reject"), F.coalesce("code_hash", F.lit("")).alias("details"))


def proxy_evidence(bytecode: DataFrame) -> DataFrame:
    """Clone, UUPS and filled admin or implementation slots (token, code, admin_slot, implementation_slot)."""
    code = F.lower(F.regexp_replace("code", "^0[xX]", ""))
    filled = lambda c: F.coalesce(F.regexp_like(c, F.lit("[1-9a-fA-F]")) & ~F.regexp_like(c, F.lit("^0[xX]0*$")), F.lit(False))
    kinds = {"PROXY_CLONE": F.regexp_like(code, F.lit(CLONE)), "PROXY_UUPS": F.regexp_like(code, F.lit("^(..)*?63" + UUPS)), "PROXY_ADMIN_SLOT": filled("admin_slot"), "PROXY_IMPLEMENTATION_SLOT": filled("implementation_slot")}
    rows = bytecode.select("token", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in kinds.items())))).alias("check"))
    return rows.select("token", "check", F.lit("WARN").alias("status"), F.when(F.col("check") == "PROXY_CLONE", "MEDIUM").otherwise("HIGH").alias("severity"), F.lit(False).alias("hard_reject"), F.lit("").alias("details"))


#: Policy of account rights: (attribute, check, severity, rejects).
ACCOUNT_POLICY = (("mint_authority", "MINT_AUTHORITY", "HIGH", False), ("freeze_authority", "FREEZE_AUTHORITY", "CRITICAL", True), ("transfer_hook", "TRANSFER_HOOK", "HIGH", False), ("permanent_delegate", "PERMANENT_DELEGATE", "CRITICAL", True), ("non_transferable", "NON_TRANSFERABLE", "CRITICAL", True))


def account_evidence(accounts: DataFrame) -> DataFrame:
    """Rights that a mint account (token and a column per attribute) leaves in place; NULL is none."""
    policy = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(c).alias("check"), F.lit(s).alias("severity"), F.lit(r).alias("reject"), F.col(a).cast("string").alias("v")) for a, c, s, r in ACCOUNT_POLICY)))
    p = accounts.select("token", policy.alias("p")).where("p.v IS NOT NULL AND p.v <> 'false'")
    return p.select("token", "p.check", F.when(F.col("p.reject"), "FAIL").otherwise("WARN").alias("status"), "p.severity", F.col("p.reject").alias("hard_reject"), F.col("p.v").alias("details"))


def program_evidence(tokens: DataFrame, pinned: list[str], known: list[str]) -> DataFrame:
    """Token program, lifecycle and bytecode rows: (token, program, state, has_code, historical, template_match)."""
    program = F.when(F.col("program").isin(*pinned), "PASS").otherwise("FAIL")
    details = F.when(F.col("program").isin(*pinned), "pinned").when(F.col("program").isin(*known), "wrong program").otherwise("unknown program")
    row = lambda check, status, severity, reject, text: F.struct(F.lit(check).alias("check"), status.alias("status"), severity.alias("severity"), reject.alias("hard_reject"), text.alias("details"))
    no = F.lit(False)
    gap = F.col("state") == "GRADUATION_GAP"
    rows = F.array(
        row("TOKEN_PROGRAM", program, F.when(program == "FAIL", "CRITICAL").otherwise("INFO"), program == "FAIL", details),
        F.when(gap, row("GRADUATION_GAP", F.lit("WARN"), F.lit("MEDIUM"), no, F.lit("between curve and pool"))),
        F.when(gap, row("SELLABILITY", F.lit("NOT_APPLICABLE"), F.lit("INFO"), no, F.lit("gap"))),
        F.when(~F.col("has_code"), row("BYTECODE", F.when(F.col("historical"), "UNKNOWN_HISTORICAL_STATE").otherwise("UNKNOWN"), F.lit("INFO"), no, F.lit("no code"))),
        F.when(F.col("has_code") & ~F.col("template_match"), row("BYTECODE_SCAN", F.lit("INFO"), F.lit("INFO"), no, F.lit("scanned"))),
    )
    return tokens.select("token", F.explode(F.array_compact(rows)).alias("r")).select("token", "r.*")
