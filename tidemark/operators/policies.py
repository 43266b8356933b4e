"""Policy chunks that answers may cite."""

CHUNKS_DDL = "chunk_id string not null, document_name string not null, section string not null, access_level string not null, chunk_text string not null"


def _chunk(chunk_id: str, document: str, section: str, access: str, text: str) -> dict:
    return {"chunk_id": chunk_id, "document_name": document, "section": section, "access_level": access, "chunk_text": text}


_CATEGORY, _BORDER, _DEVICE, _ESCALATION = "Merchant Category Risk Policy", "Cross-Border AML Procedures", "Device Risk Policy", "Escalation Policy"

#: The rules that recommended_action applies, and those they lean on, in our own words.
CHUNKS = [
    _chunk("MCR-001", _CATEGORY, "1.1 High-risk categories", "internal", "Gambling and crypto merchants, gift cards and money transfer are high risk and watched more closely; above 1,000 USD they need a second factor."),
    _chunk("MCR-002", _CATEGORY, "1.2 Volume rule", "internal", "A high-risk merchant with over 5 % fraud in 30 days goes on the watch list; then any payment above 500 USD is held for review."),
    _chunk("AML-001", _BORDER, "2.1 Reporting thresholds", "restricted", "Cross-border payments above 10,000 USD are reviewed within 24 hours; the same sum in smaller payments on one day counts as structuring and is reported."),
    _chunk("DEV-001", _DEVICE, "3.1 Rooted and emulated devices", "internal", "A rooted device or an emulator is a risk signal by itself."),
    _chunk("ESC-001", _ESCALATION, "6.1 Recommended actions", "internal", "No signal: APPROVE. One or two: HOLD_FOR_REVIEW. Three or more: ESCALATE_TO_TIER2. A money-laundering hit, structuring or fraud above 10,000 USD: FILE_SAR."),
]
