"""Ready-made patterns over a ``type`` column: sign-in abuse, fraud and journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.cep.pattern import Pattern

T = F.col


def failed_logins(n: int = 3, within: str = "5 minutes") -> Pattern:
    return Pattern("failed_logins").begin("fail", T("type") == "login_failed").times(n).within(within)


def abandonment(start: str, finish: str, within: str) -> Pattern:
    return Pattern("abandonment").begin("start", T("type") == start).not_followed_by("finish", T("type") == finish).within(within)


def sequence(name: str, *types: str, within: str, relaxed: bool = False) -> Pattern:
    p = Pattern(name, relaxed=relaxed)
    for k, t in enumerate(types):
        step = f"{t}_{k}"
        p = p.begin(step, T("type") == t) if not k else p.then(step, T("type") == t)
    return p.within(within)


def without(name: str, first: str, unwanted: str, last: str, within: str) -> Pattern:
    return Pattern(name).begin("a", T("type") == first).not_followed_by("b", T("type") == unwanted).then("c", T("type") == last).within(within)


def fraud() -> list[Pattern]:
    """Takeover after failed sign-ins, test payments before a large one, quick spending, new device, changed password."""
    big = (T("type") == "purchase") & (T("amount") > 500)
    return [
        Pattern("takeover").begin("fail", T("type") == "login_failed").times(3).then("ok", T("type") == "login_success").within("10 minutes"),
        Pattern("card_test").begin("small", (T("type") == "purchase") & (T("amount") < 5)).times(2).then("big", big).within("30 minutes"),
        Pattern("velocity").begin("buy", T("type") == "purchase").times(5).within("5 minutes"),
        Pattern("new_device").begin("ok", T("type") == "login_success").then("buy", big).within("15 minutes").where("ok", "ne", "buy", "device_id"),
        Pattern("password_then_pay").begin("change", T("type") == "password_change").then("buy", T("type") == "purchase").within("1 hour"),
    ]


def journeys() -> list[Pattern]:
    return [
        sequence("signup_to_purchase", "signup", "view", "purchase", within="7 days", relaxed=True),
        sequence("browse_and_buy", "view", "click", "purchase", within="48 hours"),
        sequence("returning", "purchase", "view", "purchase", within="14 days", relaxed=True),
        abandonment("click", "purchase", "24 hours"),
        without("recovery", "error", "signup", "purchase", "48 hours"),
        Pattern("power_user").begin("view", T("type") == "view").times(3).within("24 hours"),
        Pattern("optional_click").begin("v", T("type") == "view").then("c", T("type") == "click").optional().then("p", T("type") == "purchase").within("48 hours"),
    ]
