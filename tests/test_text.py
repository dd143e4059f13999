import unicodedata

import pytest
from pyspark.sql import functions as F

from siftwave.functions import text

MASKS = [
    ("Gap nhau luc 9h o quan cu", "Gap nhau luc 9h o quan cu"),
    ("Mo https://ngan-hang.xyz/vao ngay", "Mo <URL> ngay"),
    ("Bam bit.ly/zz9, nhanh len!", "Bam <URL>, nhanh len!"),
    ("Vao http://10.0.0.7/pay.", "Vao <URL>."),
    ("Goi 091 234 5678 hoac 0912.345.678", "Goi <PHONE> hoac <PHONE>"),
    ("Goi +84 912 345 678 hoac (+84) 912345678", "Goi <PHONE> hoac <PHONE>"),
    ("Ban may (024) 3933 1234", "Ban may <PHONE>"),
    ("Han chot 03.04.2026, gia 1.500.000d", "Han chot 03.04.2026, gia 1.500.000d"),
    ("Tong dai 1900 1234", "Tong dai 1900 1234"),
    ("Ma OTP la 445566", "Ma OTP la <OTP>"),
    ("Mã xác nhận của bạn: 12-34", "Mã xác nhận của bạn: <OTP>"),
    ("OTP 111111 roi 222222", "OTP <OTP> roi 222222"),
    ("CCCD 079123456789", "CCCD <ID>"),
    ("cmnd so 111 222 333", "cmnd so <ID>"),
    ("STK 9876543210123", "STK <ACCOUNT>"),
    ("The 1111 2222 3333 4444 555", "The <ACCOUNT>"),
    ("Gui 200000000 dong", "Gui 200000000 dong"),
    ("Thu: a.b+c@mail-x.com.vn.", "Thu: <EMAIL>."),
    ("Xem shop[.]online/a va hxxps://x(.)com", "Xem <URL> va <URL>"),
    ("Toi di TP.Me nhe", "Toi di TP.Me nhe"),
    ("Trang VCB.COM bao", "Trang <URL> bao"),
    ("Gui <URL> va <PHONE>", "Gui <URL> va <PHONE>"),
]


def test_mask_cases_and_idempotence(column):
    assert column(text.mask, [a for a, _ in MASKS]) == [b for _, b in MASKS]
    assert column(text.mask, [b for _, b in MASKS]) == [b for _, b in MASKS]


def test_pii_kinds_are_in_step_order(column):
    values = ["a@b.com, goi 0912345678, xem x.vn", "khong co gi", "ma otp 1234 va stk 123456789012345"]
    assert column(text.pii_kinds, values) == [["email", "url", "phone"], [], ["otp", "account"]]


def test_normalize_composes_and_collapses(column):
    raw = [unicodedata.normalize("NFD", "  Tiếng\u00a0\t Việt "), "a\u200bb\u00adc", "\ufeff x \n y ", "  "]
    assert column(text.normalize, raw) == ["Tiếng Việt", "abc", "x y", ""]


def test_two_refang_rule_sets_differ(column):
    values = ["hxxp://a[.]com", "a (.) b", "x[:]//y"]
    assert column(text.refang, values) == ["https://a.com", "a . b", "x://y"]
    assert column(text.restore, values) == ["http://a.com", "a.b", "x[:]//y"]


@pytest.mark.parametrize("value", ["a[.)b", "a{dot]b", "[.] b", "a [.]", "(chieu nay)"])
def test_restore_needs_balanced_brackets_between_letters(column, value):
    assert column(text.restore, [value]) == [value]


def test_has_url(column):
    values = ["co <URL> nay", "xem a[.]vn", "khong"]
    assert column(text.has_url, values) == [True, True, False]


def test_names_need_a_capital(column):
    values = ["chao anh Nam", "chao anh nam", "ms. Lan va em hoa", "thanh Anh"]
    assert column(text.may_contain_name, values) == [True, False, True, False]


def test_mask_keeping_links(column):
    values = [
        "Vao https://u:p@x.top/r?t=1#y ngay",
        "zalo.me/0912345678 nhe",
        "thu a@x.com, goi 0912\u200b345678",
        "otp www.x.vn 123456",
    ]
    assert column(text.mask_keep_urls, values) == [
        "Vao https://x.top/r ngay",
        "zalo.me/<ACCOUNT> nhe",
        "thu <EMAIL>, goi <PHONE>",
        "otp www.x.vn 123456",
    ]


def test_evidence_is_cut_with_an_ellipsis(column):
    short, long = "hxxps://a[.]vn la gia mao", "x " * 200
    out = column(text.evidence_excerpt, [short, long])
    assert out[0] == "<URL> la gia mao"
    assert len(out[1]) == 240 and out[1].endswith("…")


def test_keys_ignore_case_and_spaces(column):
    a, b, c = column(text.text_key, ["Xin  Chào", " xin chào ", "xin chao"])
    assert a == b != c and len(a) == 16


def test_codes_and_errors(column):
    assert column(text.parse_label, [" SCAM\t", "Normal", "x", None]) == ["scam", "normal", None, None]
    errors = column(lambda c: text.message_error(c, text.normalize(c)), [" \u00a0", "a" * 2001, "a" * 2000, "ok"])
    assert errors == ["classification.empty_text", "classification.text_too_long", None, None]


def test_quotes(column):
    inner = "mot doan trich dai hon ba muoi ky tu day"
    assert column(text.quotes, [f'noi “{inner}” va «ngan» va "{inner}"']) == [[inner, inner]]


def test_keywords(column):
    assert column(lambda c: text.contains_keyword(c), ["CẢNH BÁO moi", "gia vang"]) == [True, False]
    assert column(lambda c: text.contains_keyword(c, F.array(F.lit("VANG"))), ["gia vang"]) == [True]
