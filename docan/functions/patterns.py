"""Patterns of legal and business text. The fixed values below are the published ones; text matched must be the same."""

from __future__ import annotations

# Entity patterns (case-insensitive, group 1 is the value).
ENTITIES = {
    "CASE_NUMBER": r"\b(?:Case|Docket|Matter)\s+(?:No\.?|Number)\s*[:.]?\s*(\d{2,4}[-/]\w{1,5}[-/]\d{2,10}|\d{2,4}[-/]\d{2,10})",
    "BATES_NUMBER": r"\b([A-Z]{3,10}\s?\d{4,10})\b",
    "EXHIBIT_REF": r"\b(?:Exhibit|Ex\.?)\s+(?:No\.?\s*)?([A-Z0-9]{1,4}(?:[-][A-Z0-9]{1,4})?)\b",
}
# Field patterns in the order in which they are tried; group 1 or, without a group, the whole match.
FIELDS = {
    "date_iso": (r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b", False),
    "date_us": (r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b", False),
    "date_written": (
        r"\b(\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{1,2},?\s+\d{4})\b",
        True,
    ),
    "amount": (r"((?:\$|USD|EUR|GBP|CAD|AUD)\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b|\b\d{1,3}(?:,\d{3})*\.\d{2}\s*(?:USD|EUR|GBP|CAD|AUD)\b)", True),
    "phone": (r"\b((?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})\b", False),
    "email": (r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b", False),
    "reference": (r"\b((?:INV|PO|REF|SO|WO|RFQ|RFP|DOC|ID)[-#:\s]*\d{3,10}(?:[-]\d{1,6})?)\b", True),
}
# Words that tell the type of a document.
DOCUMENT_TYPES = {
    "invoice": [r"\binvoice\b", r"\bbill\s+to\b", r"\bamount\s+due\b", r"\bpayment\s+terms\b", r"\btotal\s*:", r"\bsubtotal\b", r"\binv[#\-]\s*\d+", r"\bdue\s+date\b"],
    "contract": [r"\bagreement\b", r"\bhereby\b", r"\bparties\b", r"\bwhereas\b", r"\bwitnesseth\b", r"\bexecuted\b", r"\bterms\s+and\s+conditions\b", r"\bindemnif"],
    "letter": [r"\bdear\b", r"\bsincerely\b", r"\bregards\b", r"\bto\s+whom\s+it\s+may\s+concern\b", r"\byours\s+truly\b"],
    "form": [r"\bfill\s+in\b", r"\bplease\s+complete\b", r"\bapplicant\b", r"\bcheckbox\b", r"\bsignature\s+(?:line|block|below)\b", r"\b(?:first|last)\s+name\s*:", r"\bdate\s+of\s+birth\b"],
    "report": [r"\bexecutive\s+summary\b", r"\bfindings\b", r"\bmethodology\b", r"\bconclusion\b", r"\bappendix\b", r"\babstract\b"],
    "memo": [r"\bmemorandum\b", r"\bmemo\b"],
    "receipt": [r"\breceipt\b", r"\btransaction\b", r"\bpaid\b", r"\bchange\s+due\b", r"\bcard\s+ending\b"],
}
# A memo must also hold two of these.
MEMO_HEADS = [r"\bto\s*:", r"\bfrom\s*:", r"\bsubject\s*:"]
# Families of error messages, the first that matches wins.
FAILURES = {
    "ocr_text": ["no text extracted", "ocr.*empty", "text extraction.*failed", "blank.*page", "insufficient.*text"],
    "critical": ["out of memory", "cuda.*error", "gpu.*error", "system.*error", "permission denied"],
    "extract_failed": ["extract.*failed", "pdf.*corrupt", "cannot.*render", "invalid.*pdf", "decrypt.*failed"],
}
# Blocks of scripts (first and last code point).
SCRIPTS = {
    "latin": r"A-Za-zÀ-ɏ",
    "greek": r"Ͱ-Ͽ",
    "cyrillic": r"Ѐ-ӿ",
    "arabic": r"؀-ۿݐ-ݿ",
    "devanagari": r"ऀ-ॿ",
    "georgian": r"Ⴀ-ჿ",
    "cjk": r"一-鿿぀-ヿ가-힣",
}
# Signs of legal privilege.
PRIVILEGE = ["attorney-client", "attorney client", "work product", "privileged and confidential", "privileged & confidential", "attorney work product", "do not disclose", "legally privileged"]
