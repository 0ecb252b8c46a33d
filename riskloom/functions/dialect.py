"""The few spots where the SQL of Spark and of the checking engine differ, so that one rule text serves both."""

from __future__ import annotations


class Spark:
    duck = False

    @staticmethod
    def match(text: str, pattern: str) -> str:
        return f"rlike({text}, r'{pattern}')"

    @staticmethod
    def swap(text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, r'{pattern}', '{by}')"

    @staticmethod
    def part(text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, r'{pattern}', {group})"

    @staticmethod
    def parts(text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, r'{pattern}', 0)"

    @staticmethod
    def decode(text: str) -> str:
        return f"try_url_decode(regexp_replace(replace({text}, '+', '%2B'), r'%(?![0-9A-Fa-f][0-9A-Fa-f])', '%25'))"

    @staticmethod
    def form(text: str) -> str:
        """Decoding of query strings, where a plus is a blank."""
        return f"try_url_decode(regexp_replace({text}, r'%(?![0-9A-Fa-f][0-9A-Fa-f])', '%25'))"

    @staticmethod
    def number(text: str) -> str:
        return f"try_cast({text} AS DOUBLE)"

    even = "bround"
    size = "size"
    text_type = "STRING"


class Duck(Spark):
    duck = True

    @staticmethod
    def match(text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    @staticmethod
    def swap(text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    @staticmethod
    def part(text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, '{pattern}', {group})"

    @staticmethod
    def parts(text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, '{pattern}')"

    @staticmethod
    def decode(text: str) -> str:
        return f"url_decode({text})"

    @staticmethod
    def form(text: str) -> str:
        return f"url_decode(replace({text}, '+', ' '))"

    even = "round_even"
    size = "len"
    text_type = "VARCHAR"
