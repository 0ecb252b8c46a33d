"""Inputs of the registered queries, derived from the given tables by SQL that every engine reads alike.

The tables' prose has next to none of the vocabulary that the rules look for, so messages, links and payment links
are put together from a row's own columns and a template that its id picks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread

_TEMPLATES = (
    "URGENT: your bank account will be blocked today only. Update KYC at http://sbi-verify.example.tk/login",
    "Dear customer, share OTP and enter PIN to confirm your SBI debit card, call us on the helpline",
    "You have won a lottery prize of 25 lakh! Pay the processing fee via UPI, click here bit.ly/win25",
    "Work from home data entry job offer, pay registration fee to 98@upi, no experience needed",
    "Guaranteed return: double your money in crypto, send money now, guaranteed profit",
    "Instant loan approved, personal loan pre-approved, processing fee by paytm, open the link www.quick-loan.example/apply",
    "Your parcel is stuck at customs, pay the delivery fee: 10.20.30.40/pay",
    "Income tax refund pending, court summons and legal action, verify at http://incometax-refund.example.ga/verify?redirect=x",
    "Instagram: your account hacked, your friend needs emergency help, send money immediately",
    "Rs 5000 credited to your account. Do not share OTP with anyone. Official app only.",
    "Payment received, your ticket has been booked successfully",
    "खाता बंद हो जाएगा, तुरंत केवाईसी अपडेट करें, ओटीपी दें",
    "आधार आणि पासवर्ड पाठवा, बँक खाते ब्लॉक, लिंक खोलें",
    "Aapka account band hone wala hai, jaldi kyc update karo, otp batao, link kholo",
    "See you at dinner tonight, bring the documents",
    "Meeting moved to 5 pm, agenda at https://www.google.com/calendar",
    "Electricity bill unpaid, power cut tonight, hurry, last chance, contact customer care helpline support",
    "Send OTP to verify, tell the one-time password to our support team",
    "Visit t.co/abc and www.example.com/free-prize, this link is safe",
    "Your courier package delivery is today, ignore if received",
    "Your bank will never ask for a PIN, never share it",
    "Refund of cashback pending, collect request sent, pay now by UPI, your UPI ID and bank details needed",
)


def _case(value: str, options, otherwise: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '" + t.replace("'", "''") + "'" for k, t in enumerate(options))
    return f"CASE {value} {whens} ELSE {otherwise} END"


MESSAGES = f"""SELECT doc_id AS msg_id, lang, {_case('doc_id % 24', _TEMPLATES, "''")} || ' ' || text AS text FROM documents"""

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_TAIL = "regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)"
URLS = f"""SELECT page_id AS url_id, CASE page_id % 32
  WHEN 0 THEN 'http://user:secret@' || {_HOST} || {_TAIL}
  WHEN 1 THEN 'http://' || {_HOST} || ':8080' || {_TAIL}
  WHEN 2 THEN 'http://192.168.' || CAST(page_id % 250 AS {{text}}) || '.7/login' || {_TAIL}
  WHEN 3 THEN 'https://xn--pypal-4ve.example/' || CAST(page_id AS {{text}})
  WHEN 4 THEN 'https://paypal.account-verify.example/' || CAST(page_id AS {{text}})
  WHEN 5 THEN 'https://paypa1.example' || {_TAIL}
  WHEN 6 THEN 'http://7f000001.example' || {_TAIL}
  WHEN 7 THEN url || '?next=http%3A%2F%2Fevil.example%2Fpay'
  WHEN 8 THEN url || '?redirect=https://other.example/login&utm_source=mail'
  WHEN 9 THEN 'https://' || {_HOST} || '/' || repeat('long-path/', 30) || CAST(page_id AS {{text}})
  WHEN 10 THEN url || '?a=1&b=2&c=3&d=4&e=5&f=6&token=x'
  WHEN 11 THEN 'http://secure-login-verify-sbi.example' || {_TAIL}
  WHEN 12 THEN 'http://123456789.example.tk' || {_TAIL}
  WHEN 13 THEN 'https://onlinesbi.com/login'
  WHEN 14 THEN 'https://www.sbi.co.in' || {_TAIL}
  WHEN 15 THEN 'bit.ly/' || CAST(page_id AS {{text}})
  WHEN 16 THEN 'javascript:alert(' || CAST(page_id AS {{text}}) || ')'
  WHEN 17 THEN 'https://a.b.c.d.e.' || {_HOST} || {_TAIL}
  WHEN 18 THEN 'https://www.google.com@' || {_HOST} || {_TAIL}
  WHEN 19 THEN 'https://a@b@' || {_HOST} || {_TAIL}
  WHEN 20 THEN 'https://' || {_HOST} || '/%61%62%63%64%65%66?q=%20%21%22%23'
  WHEN 21 THEN 'https://gooogle.example' || {_TAIL}
  WHEN 22 THEN 'https://sbi.kyc-update.example.co.in/verify?otp=1&pin=2&account=3'
  WHEN 23 THEN 'example.com:8080/kyc/paytm'
  WHEN 24 THEN 'https://pаypal.example' || {_TAIL}
  WHEN 25 THEN ''
  WHEN 26 THEN 'https://' || {_HOST} || '/a//b/c/d/e/f/g'
  ELSE url END AS url FROM pages"""

LINKS = f"""SELECT page_id AS link_id, CASE WHEN page_id % 16 = 15 THEN NULL ELSE url END AS baseline_url, CASE page_id % 16
  WHEN 0 THEN url
  WHEN 1 THEN 'http://' || {_HOST} || {_TAIL}
  WHEN 2 THEN 'https://login.' || {_HOST} || {_TAIL}
  WHEN 3 THEN 'https://' || {_HOST} || ':8443' || {_TAIL}
  WHEN 4 THEN 'https://' || {_HOST} || '/changed' || CAST(page_id AS {{text}})
  WHEN 5 THEN 'https://' || {_HOST} || '/?redirect=https://evil.example/pay'
  WHEN 6 THEN 'https://' || {_HOST} || '/?token=1&gclid=2&x=3'
  WHEN 7 THEN 'https://' || {_HOST} || '/?to=http%3A%2F%2Fevil.example'
  WHEN 8 THEN 'https://10.1.2.3' || {_TAIL}
  WHEN 9 THEN 'https://paypal.' || {_HOST} || '.verify.example.tk' || {_TAIL}
  WHEN 10 THEN 'https://' || {_HOST} || '/%61%62%63%64%65'
  WHEN 11 THEN 'https://' || {_HOST} || '/#other'
  WHEN 12 THEN 'bit.ly/' || CAST(page_id AS {{text}})
  WHEN 13 THEN 'https://' || {_HOST} || '/?ref=y&page=9'
  ELSE url END AS current_url FROM pages"""

_NOTES = ("Order", "urgent refund, claim now", "KYC update, verify account today only", "share OTP and PIN", "gift prize winner, act now, password", "lunch", "rent", "won lottery")
PAYMENTS = f"""SELECT o_orderkey AS pay_id, CASE o_orderkey % 16
  WHEN 14 THEN 'upi://mandate?pa=c' || CAST(o_custkey AS {{text}}) || '@upi'
  WHEN 15 THEN 'upi://pay?am=' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS {{text}})
  ELSE 'upi://pay?pa=c' || CAST(o_custkey AS {{text}}) || '@upi' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '&pn=Shop+' || CAST(o_custkey % 50 AS {{text}}) END
    || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '&am=' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS {{text}}) END || '&cu=INR&tn=' || replace({_case('o_orderkey % 8', _NOTES, "''")}, ' ', '%20')
  END AS uri FROM orders"""

SENDERS = f"""SELECT s_suppkey AS sender_id, CASE s_suppkey % 6 WHEN 0 THEN 'SBI Alerts' WHEN 1 THEN 'PayPal Support' WHEN 2 THEN 'Google' WHEN 3 THEN 'Amazon' WHEN 4 THEN '' ELSE s_name END AS display_name,
  CASE s_suppkey % 5 WHEN 0 THEN 'info@sbi.co.in' WHEN 1 THEN 'help@mail.paypal.com' WHEN 2 THEN 'x@evil.example' WHEN 3 THEN 'a@amazon.evil.example' ELSE '' END AS sender_email,
  CASE s_suppkey % 4 WHEN 0 THEN 'google.com' WHEN 1 THEN 'cheap.example' ELSE '' END AS sender_domain,
  CASE s_suppkey % 9 WHEN 0 THEN 'invoice.EXE' WHEN 1 THEN 'photos.zip' WHEN 2 THEN 'notes.txt' WHEN 3 THEN 'macro.docm' WHEN 4 THEN 'run.js' WHEN 5 THEN '' WHEN 6 THEN 'archive.tar.7z' WHEN 7 THEN 'noext' ELSE ' setup.msi ' END AS filename FROM supplier"""

LABELLED = """SELECT d.doc_id AS id, d.text, d.lang AS language, CASE WHEN l.toxic = 1 THEN 'scam' ELSE 'safe' END AS label, 'type' || CAST(d.doc_id % 13 AS {text}) AS scam_type, d.source
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers the given parquet tables as views of their own names."""
    for name in names:
        spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")).createOrReplaceTempView(name)


def read(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A derived input as a DataFrame."""
    tables(spark, sf_dir, *names)
    return spark.sql(sql.format(text="STRING") if "{text}" in sql else sql)


def duck(sql: str) -> str:
    return sql.format(text="VARCHAR") if "{text}" in sql else sql
