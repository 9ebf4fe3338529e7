"""Column functions over log text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values -----------------------------------------------------------------
WORD = r"[A-Za-z0-9_\-]+"
KEYWORDS = (
    r"ORA-\d{5}", r"sd[a-z]+", r"hdisk\d+", r"bond\d+", r"qla2xxx", r"nf_conntrack", r"oom-killer", r"EXT4-fs", r"XFS", r"multipathd",
    r"nfs:.*server", r"kernel panic", r"soft lockup", r"hard lockup", r"FAILED|failed", r"ERROR|error", r"TIMEOUT|timeout",
)
ERROR_WORDS = ("error", "fail", "fatal", "critical", "emerg", "alert")
FATAL_WORDS = ("fatal", "emerg", "panic")
ALWAYS_KEPT = ("ORA-", "WARNING", "ERROR", "FAILED", "CRITICAL", "FATAL", "KILLED", "TERMINATED", "DISMOUNT", "READ FAILED")
INJECTION = (
    r"\brm\s+-rf?\b", r"\bchmod\b", r"\bkill\b", r"\bkillall\b", r"\bdrop\s+table\b", r"\bdrop\s+database\b", r"\bgrant\s+dba\b",
    r">\s*alert\.log\b", r"\bdd\b",
)
#: most dangerous first
COMMAND_CLASSES = ("DESTRUCTIVE_DBA_APPROVAL_REQUIRED", "HIGH_RISK_REMEDIATION", "REMEDIATION", "LOW_RISK_REMEDIATION", "DIAGNOSTIC")
DESTRUCTIVE = r"clear\s+unarchived|resetlogs|until\s+cancel|drop\s+logfile|drop\s+disk|offline.*disk|force\s+dismount|alter\s+database\s+recover"
HIGH_RISK = (
    r"\b(shutdown\s+(immediate|abort|transactional)|startup\s+force|alter\s+database\s+(open|recover|mount)|"
    r"alter\s+diskgroup\s+[^;]*drop)"
)
READ_ONLY = (
    r"^\s*(select\b|grep\b|dmesg\b|multipath\b|cat\b|tail\b|head\b|ipcs\b|sysctl\b|df\b|free\b|chronyc\b|asmcmd\s+ls|cellcli\s+-e\s+list|"
    r"adrci\b|systool\b|iscsiadm\b|kfod\b|lsblk\b|lsscsi\b|systemctl\s+status\b)"
)
#: in this order, the first one that a command matches
COMMAND_RULES = (
    (r"^$", "DIAGNOSTIC"),
    (DESTRUCTIVE, "DESTRUCTIVE_DBA_APPROVAL_REQUIRED"),
    (HIGH_RISK, "HIGH_RISK_REMEDIATION"),
    (r"(?s)^(?!.*check datafiles).*\balter\s+(database|system)\b", "HIGH_RISK_REMEDIATION"),
    (READ_ONLY, "DIAGNOSTIC"),
    (r"show incident|lsdg", "DIAGNOSTIC"),
    (r"alter system check datafiles", "LOW_RISK_REMEDIATION"),
)
NEVER = r"(?!)"
#: points, what a file's name has to have, or else its path
FILE_POINTS = (
    (2, r"\.(log|trc|txt|out|html|xml|json|csv)$", NEVER),
    (100, r"alert", r"trace/"),
    (70, r"lgwr|dbwr|ckpt|smon|pmon|arc|mmon", NEVER),
    (65, r"asm", r"\+asm|/asm/"),
    (60, NEVER, r"crs|css|ohasd|crsctl|grid"),
    (55, r"^(secure|auth\.log)$|messages|syslog|dmesg", NEVER),
    (52, r"cellsrv|cellalert|ms_|rs_", r"/cell"),
    (48, r"cellcli|dcli", NEVER),
    (42, r"^iostat|vmstat|mpstat|sar", r"osw"),
    (38, r"awr|ash|addm", NEVER),
    (35, r"audit", r"adump"),
    (32, NEVER, r"orachk|exachk|ahf|tfa|insights"),
)
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
ROTATION = r"(\.log)?([-.]\d+)?(\.gz)?$"
# -----------------------------------------------------------------------------


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more; codes stay whole."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return F.filter(F.transform(found, F.lower), lambda t: F.length(t) >= 2)


def keywords(text: Column, most: int = 10, width: int = 30) -> Column:
    """distinct notable words, sorted so that the first ones are defined."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(f"(?i)({p})")), lambda x: F.substring(x, 1, width)) for p in KEYWORDS]
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.array(*found)))), 1, most)


def message_severity(text: Column) -> Column:
    """F9"""
    low = F.lower(text)
    return (
        F.when(contains_any(low, ERROR_WORDS), F.when(contains_any(low, FATAL_WORDS), "CRITICAL").otherwise("ERROR"))
        .when(low.contains("warn"), "WARNING").otherwise("INFO")
    )


def strip_benign_lines(text: Column, benign: list[str]) -> Column:
    """drops benign lines of a text of several lines; a single benign line
    is rejected whole (empty)."""
    noise = lambda line: reduce(lambda a, b: a | b, [line.rlike(f"(?i){p}") for p in benign])
    kept = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) == "") | contains_any(F.upper(F.trim(x)), ALWAYS_KEPT) | ~noise(F.trim(x)))
    several = F.trim(text).contains("\n")
    return F.when(several, F.array_join(kept, "\n")).when(noise(text), "").otherwise(text)


def strip_html(html: Column) -> Column:
    """Breaks and paragraph ends become lines, tags go, entities are
    decoded, more than two line ends in a row become two."""
    out = F.regexp_replace(html, r"(?i)<br\s*/?>|</p>|</tr>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def redact(text: Column) -> Column:
    """Command substitutions and dangerous commands are blanked."""
    out = F.regexp_replace(text, r"`[^`]*`", "[REDACTED EXECUTION]")
    out = F.regexp_replace(out, r"\$\([^)]*\)", "[REDACTED EXECUTION]")
    for p in INJECTION:
        out = F.regexp_replace(out, f"(?i){p}", "[REDACTED COMMAND]")
    return out


def command_class(command: Column) -> Column:
    """The safety class of one command line, that of the first rule."""
    low = F.lower(F.trim(F.coalesce(command, F.lit(""))))
    first = F.when(F.lit(False), "")
    for pattern, name in COMMAND_RULES:
        first = first.when(low.rlike(pattern), name)
    return first.otherwise("REMEDIATION")


def bundle_class(commands: Column) -> Column:
    """The most dangerous command decides; no command is diagnostic."""
    order = F.array(*[F.lit(c) for c in COMMAND_CLASSES])
    ranks = F.transform(commands, lambda c: F.array_position(order, command_class(c)))
    return F.element_at(order, F.coalesce(F.array_min(ranks), F.lit(len(COMMAND_CLASSES))).cast("int"))


def rotation_base(name: Column) -> Column:
    """The name that rotated files of one log share."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    short = F.regexp_replace(base, ROTATION, "")
    return F.when(short == "", base).otherwise(short)


def file_priority(path: Column) -> Column:
    """diagnostic value of a bundle member, the sum of its rules' points."""
    whole, name = F.lower(path), F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return reduce(lambda a, b: a + b, [F.when(name.rlike(in_name) | whole.rlike(in_path), points).otherwise(0) for points, in_name, in_path in FILE_POINTS])


def clean(text: Column, limit: int) -> Column:
    """NUL bytes go, the rest is clipped."""
    return F.substring(F.translate(text, "\0", ""), 1, limit)


def finite(number: Column, default: float = 0.0) -> Column:
    """null, NaN and infinities become the default."""
    ok = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(ok, number).otherwise(F.lit(default))
