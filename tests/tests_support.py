"""Records for tests."""

RECORD = "record_id string, subset string, family_id string, document_ids array<string>, source_texts map<string,string>, rights_status string, source_license string, source_name string, synthetic boolean, split string, answer struct<question string, status string, evidence array<struct<document_id string, text string, page_number int, section string, start_char int, end_char int>>>, turns array<struct<role string, text string>>"


def record(i, **over):
    base = {"record_id": i, "subset": "evidence_conversation", "family_id": "f", "document_ids": ["d"], "source_texts": {"d": "Rent is due. Parking is free."}, "rights_status": "public_domain", "source_license": None, "source_name": "s", "synthetic": False, "split": "train", "answer": None, "turns": None}
    return tuple({**base, **over}.values())
