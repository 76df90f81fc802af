"""Identifiers on a line of folded text: contact details, registrations, cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import after_first, first, strip

# Patterns of labels and values.
PHONE = r"(?<![\d])(\+?\d{1,3}[\s.\-]?)?(\(?\d{2,4}\)?[\s.\-]?)?\d{3}[\s.\-]?\d{2,4}([\s.\-]?\d{2,4})?(?![\d])"
PHONE_LABEL = r"(?iU)\b(TEL|TELEPHONE|PHONE|PH|MOB|MOBILE|CONTACT|CALL|FAX)\b[.:\s#]*"
NOT_PHONE = r"(?iU)\b(TOTAL|SUBTOTAL|TAX|VAT|CASH|CHANGE|CARD|QTY|ITEM|DATE|TIME|AUTH|APPR)\b"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
URL = r"(?U)\b((?:https?://)?(?:www\.)[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?:/\S*)?)\b|\b((?:https?://)[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?:/\S*)?)\b"
TAX_ID = r"(?iU)\b(VAT(?:\s*(?:NO|NUMBER|REG|ID))?|GST(?:\s*(?:NO|NUMBER|IN))?|GSTIN|TIN|TAX\s*ID|TAX\s*NO|ABN|ACN|NIF|CIF|CUIT|BIN|EIN|UID|USt-IdNr|SIRET)\b[.:\s#]*"
REGISTRATION = r"(?iU)\b(REG(?:\.|ISTRATION)?\s*(?:NO|NUMBER|ID)?|COMPANY\s*(?:NO|NUMBER)|CRN|BRN|TRADE\s*LICENSE|LICENSE\s*NO)\b[.:\s#]*"
RECEIPT = (
    r"(?iU)\b(RECEIPT|RCPT|INVOICE|INV|BILL|ORDER|TRANS(?:ACTION)?|TXN|TRX|REF(?:ERENCE)?|TICKET|CHECK|DOC(?:UMENT)?|SALE|REG(?:ISTER)?"
    r"|BELEG|KASSENBON|RECHNUNG|QUITTUNG|FACTURE|RECU|FACTURA|RECIBO|NOTA|FATTURA|SCONTRINO)\s*[-.]?\s*(?:NO|NR|NUM(?:BER)?|ID|N|#)?\b[.:\s#-]*"
)
VALUE = r"(?i)([A-Z0-9][A-Z0-9\-/_:]{1,35})"
AUTH = r"(?iU)\b(?:AUTH(?:ORI[SZ]ATION)?|APPROVAL|APPR)\s*(?:CODE|NO|#)?\b[.:\s#]*([A-Z0-9]{4,12})\b"
CARDS = {
    "VISA": "VISA", "MASTERCARD": "MASTERCARD", "MASTER CARD": "MASTERCARD", "MC": "MASTERCARD", "AMEX": "AMEX", "AMERICAN EXPRESS": "AMEX",
    "DISCOVER": "DISCOVER", "DINERS": "DINERS", "JCB": "JCB", "UNIONPAY": "UNIONPAY", "MAESTRO": "MAESTRO", "RUPAY": "RUPAY",
}
STORE = r"(?iU)\b(?:STORE|STR|BRANCH|LOC|LOCATION|SITE)\s*[:#.\s]*([A-Za-z0-9\-_]{1,15})\b"
#: What a line must hold for a rule to find anything in it: words that begin its labels, or signs; cheaper than the rule.
MAY = {
    "phone": r"(?iu)TEL|PH|MOB|CONTACT|CALL|FAX|\+",
    "email": "@",
    "website": r"://|www\.",
    "tax_id": r"(?iu)VAT|GST|TIN|TAX|ABN|ACN|NIF|CIF|CUIT|BIN|EIN|UID|UST|SIRET",
    "registration_id": r"(?iu)REG|COMPANY|CRN|BRN|TRADE|LICENSE",
    "receipt_number": r"(?iu)R(?:EC|CPT|EF|EG)|INV|B(?:ILL|ELEG)|ORDER|T(?:RANS|XN|RX|ICKET)|CHECK|DOC|SALE|KASSENBON|QUITTUNG|F(?:ACT|ATT)|NOTA|SCONTRINO",
    "store_id": r"(?iu)ST(?:OR|R)|BRANCH|LOC|SITE",
    "card_type": r"(?iu)VISA|M(?:ASTER|C|AESTRO)|AM(?:EX|ERICAN)|DI(?:SC|NERS)|JCB|UNIONPAY|RUPAY",
    "auth_code": r"(?iu)AUTH|APPR",
}
NOT_STORE = ("NO", "NUMBER", "ID", "TAX", "TEL", "FAX")


def _phone(raw: Column) -> Column:
    """Digits and plus of a match with 7 to 15 digits."""
    kept = F.regexp_replace(raw, r"[^\d+]", "")
    return F.when(F.length(F.regexp_replace(kept, r"^\++", "")).between(7, 15), kept)


def phone(text: Column) -> Column:
    """After a label, else with an international prefix; a bare run of digits is none."""
    labelled = text.rlike(PHONE_LABEL)
    bare = strip(text)
    return F.when(labelled, _phone(first(after_first(text, PHONE_LABEL), PHONE))).when(~text.rlike(NOT_PHONE) & bare.startswith("+"), _phone(first(bare, PHONE)))


def email(text: Column) -> Column:
    return F.lower(first(text, EMAIL))


def website(text: Column) -> Column:
    """A URL with a scheme or www."""
    return F.lower(F.regexp_replace(F.coalesce(first(text, URL, 1), first(text, URL, 2)), r"[.,;]+\z", ""))


def labelled_id(text: Column, labels: str) -> Column:
    """The token after a label; it must hold a digit."""
    rest = strip(after_first(text, labels))
    value = F.regexp_replace(first(rest, VALUE, 1), r"^[ \-/_]+|[ \-/_]+\z", "")
    return F.when(value.rlike(r"\d"), value)


def tax_id(text: Column) -> Column:
    return labelled_id(text, TAX_ID)


def registration_id(text: Column) -> Column:
    return labelled_id(text, REGISTRATION)


def receipt_number(text: Column) -> Column:
    return labelled_id(text, RECEIPT)


def card_type(text: Column) -> Column:
    """The first scheme in table order."""
    up = F.upper(text)
    return F.coalesce(*[F.when(up.rlike(rf"(?U)\b{needle}\b"), scheme) for needle, scheme in CARDS.items()])


def auth_code(text: Column) -> Column:
    return F.upper(first(text, AUTH, 1))


def store_id(text: Column) -> Column:
    value = strip(first(text, STORE, 1))
    return F.when(~F.upper(value).isin(*NOT_STORE), value)
