"""All registered queries of the risk operators, and the SQL that checks them."""

from __future__ import annotations

from . import data_plans, explain_plans, intel_plans, live_plans, message_plans, payment_plans, url_plans, verdict_plans

MODULES = [message_plans, url_plans, payment_plans, data_plans, intel_plans, verdict_plans, live_plans, explain_plans]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
