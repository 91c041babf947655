"""Text-quality checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of personal data, in order of precedence.
PATTERNS = {
    "id_card": r"(?<!\d)[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)",
    "phone": r"(?<!\d)1[3-9]\d{9}(?!\d)",
    "bank_card": r"(?<!\d)[1-9]\d{15,18}(?!\d)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip": r"(?<!\d)(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d)",
    "passport": r"\b[EeGgKkPpHh]\d{8}\b",
}
LENGTH_LIMIT = 2000
#: Signs of an injected prompt, in order; the first decides.
INJECTIONS = [
    r"(?i)ignore\s+(all\s+)?previous\s+(instructions|prompts|rules)",
    r"(?i)ignore\s+(all\s+)?above",
    r"(?i)disregard\s+(all\s+)?(previous|above|prior)\s+(instructions|rules|prompts)",
    r"(?i)system\s*prompt",
    r"(?i)you\s+are\s+now\s+a",
    r"(?i)new\s+instructions?\s*:",
    r"(?i)jailbreak",
    r"\bDAN\b",
    r"(?i)<\s*script",
    r"(?i)```\s*(system|assistant|user)\s*:",
    r"(?i)pretend\s+(you\s+are|to\s+be)\s+a",
    r"(?i)act\s+as\s+(if\s+you\s+(are|were)\s+)?a",
    r"(?i)override\s+(your|the)\s+(instructions|rules|guidelines)",
    r"(?i)reveal\s+(your|the)\s+(system|hidden|internal)\s+(prompt|instructions|rules)",
    r"忽略(以上|前面|之前|上面|先前)(的)?(所有|全部)?(指令|规则|提示|提示词|内容|要求|设定)",
    r"无视(以上|前面|之前|上面|先前)(的)?(所有|全部)?(指令|规则|提示|内容|要求|设定)",
    r"不要(遵守|理会|执行|遵循)(以上|前面|之前|上面|系统|任何)(的)?(指令|规则|提示|限制)",
    r"你现在是(一个)?(DAN|开发者模式|无限制|无限制模式|越狱|管理员)",
    r"进入(开发者|越狱|无限制|DAN|root|admin).{0,4}模式",
    r"越狱",
    r"(扮演|假装|模拟)(成|为|是)?(一个)?(DAN|没有限制|不受限|无道德|越狱).{0,6}(AI|助手|模型|角色|身份)",
    r"(输出|打印|显示|告诉我|给出|展示)(你的|系统的|真实的)?(系统|内部|隐藏|真实|初始)(的)?(提示词|提示|指令|规则|prompt|设定)",
    r"取消(所有|全部)?(限制|安全|道德)(限制|策略|规则)?",
]
INJECTION = "|".join(f"(?:{p})" for p in INJECTIONS)
#: Fixed value: what makes a claim a hard one (a limit, a step, a conclusion, a number with its unit).
HARD = r"(?i)(应为|限值|阈值|不大于|不超过|不得|必须|步骤|建议|结论|\d+(\.\d+)?\s*(IPS|mm|℃|°C|%|kg|MPa|kPa|V|A|rpm)|\d+[）.)])"
#: Signs of doubt and of contradiction in a reasoning, of a manipulation, and of a note on risks in an answer.
HEDGE = r"(?i)不确定|可能|也许|大概|似乎|推测|猜测|不肯定|存疑|unsure|uncertain|maybe|perhaps|might|guess|unclear"
CONTRADICTION = r"(?i)矛盾|冲突|不一致|相反|but also|however|on the other hand"
MANIPULATION = ("hack", "exploit", "bypass", "绕过", "破解")
RISK_NOTES = ("风险", "安全提示", "仅供参考")


def found(text: Column, kind: str) -> Column:
    return text.rlike(PATTERNS[kind])


def any_personal_data(text: Column) -> Column:
    out = found(text, "id_card")
    for kind in list(PATTERNS)[1:]:
        out = out | found(text, kind)
    return out


def redact(text: Column, operational: list[tuple[str, str]] = ()) -> Column:
    """The text with a mark in place of each kind of personal data; then of a domain's own (kind, pattern) pairs, none by default."""
    for kind, pattern in [*PATTERNS.items(), *operational]:
        text = F.regexp_replace(text, pattern, f"[已脱敏:{kind}]")
    return text


def too_long(text: Column, limit: int = LENGTH_LIMIT) -> Column:
    return F.length(text) > limit


def injection(text: Column) -> Column:
    return text.rlike(INJECTION)


def verdict(text: Column) -> Column:
    return F.when(too_long(text), "block:length").when(injection(text), "block:injection").otherwise("allow")


def hard_claim(claim: Column) -> Column:
    return claim.rlike(HARD)


def escalation(hallucinated: Column, has_sources: Column, has_reasoning: Column, answer_length: Column) -> Column:
    return F.when(hallucinated, "critical").when(~has_sources, "high").when(~has_reasoning & (answer_length < 100), "medium").otherwise("none")


def cited(citation: Column, sources: Column) -> Column:
    """Whether a citation and some source hold one another."""
    return F.exists(sources, lambda s: s.contains(citation) | citation.contains(s))


def off_topic(text: Column, keywords: list[str]) -> Column:
    """A text that holds none of the keywords and a sign of manipulation; without keywords nothing is."""
    if not keywords:
        return F.lit(False)
    low = F.lower(text)
    held = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    return ~held([k.lower() for k in keywords]) & held(list(MANIPULATION))


def with_disclaimer(answer: Column, disclaimer: str) -> Column:
    """The answer, with the disclaimer after it unless it notes risks itself."""
    noted = F.exists(F.array(*map(F.lit, RISK_NOTES)), lambda w: answer.contains(w))
    return F.when(noted, answer).otherwise(F.concat(answer, F.lit(disclaimer)))


def reflection(claims: Column, reasoning: Column, grounding: Column) -> Column:
    """confident, contradiction or uncertain: what a reasoning says of an answer that makes hard claims.

    Doubts count where the grounding is unknown or below 0.5.
    """
    hard = F.exists(claims, hard_claim)
    blank = F.trim(F.coalesce(reasoning, F.lit(""))) == ""
    doubtful = reasoning.rlike(HEDGE) & (F.coalesce(grounding, F.lit(0.0)) < 0.5)
    return F.when(blank | ~hard, "confident").when(reasoning.rlike(CONTRADICTION), "contradiction").when(doubtful, "uncertain").otherwise("confident")


def hallucination(hard: Column, supported: Column) -> Column:
    """Of claims' flags (arrays in step): the share of judged hard claims that nothing supports; 0 if none was judged."""
    judged = F.filter(F.zip_with(hard, supported, lambda h, s: F.when(h, s)), lambda s: s.isNotNull())
    return F.when(F.size(judged) > 0, F.size(F.filter(judged, lambda s: ~s)) / F.size(judged)).otherwise(0.0)
