"""Texts the query and payload views are filled with."""

#: (gold task, query); ``{x}`` becomes the event type.
TEMPLATES = [
    ("fusion", "Use the SAR and optical images together to map {x} areas"),
    ("fusion", "Combine optical cues with the SAR scene for {x}"),
    ("fusion", "Run a cross-modal reading of this {x} pair"),
    ("fusion", "Fuse both sensors to outline {x}"),
    ("fusion", "Give a joint analysis of the {x} scene"),
    ("fusion", "Are the two sources complementary for {x}?"),
    ("fusion", "Match radar echoes to visible {x} roofs"),
    ("fusion", "Check visible {x} bands against the microwave pass"),
    ("fusion", "Cross-reference the {x} layers"),
    ("fusion", "Merge sar and optical {x} information to identify flooded areas"),
    ("change", "What changed near the {x} site?"),
    ("change", "Has vegetation increased around the {x}?"),
    ("change", "Has the {x} area increased, decreased, or remained unchanged?"),
    ("change", "Compare the {x} fields on both dates"),
    ("change", "Land use shifted between surveys of {x}"),
    ("change", "Is the lake larger or smaller than the {x}?"),
    ("change", "Show differences between the {x} scenes"),
    ("change", "Look at the {x} before and after the flood"),
    ("change", "Track the {x} shoreline over time"),
    ("change", "The {x} reservoir shrank"),
    ("change", "Roads grew a lot since the {x} survey"),
    ("change", "New construction near the {x}"),
    ("change", "Was there deforestation in the {x} block?"),
    ("change", "Buildings that appeared at the {x}"),
    ("change", "Growth of {x} between 2015 and 2020"),
    ("change", "From 2010 to 2018 how did {x} fare"),
    ("change", "Detect changes around the {x} port"),
    ("change", "Bi-temporal check of {x}"),
    ("grounding", "Highlight the {x} water body referred to in the query."),
    ("grounding", "Locate the {x} buildings in this image"),
    ("grounding", "Localise every {x} pond"),
    ("grounding", "Where is the {x} river?"),
    ("grounding", "Find the {x} runway in the second image"),
    ("grounding", "Draw a bounding box around the {x} dock"),
    ("grounding", "Mark the {x} roads for me"),
    ("grounding", "Point to the {x} airport in the image"),
    ("grounding", "Show me where the {x} forest is"),
    ("grounding", "Delineate the {x} parcels"),
    ("grounding", "Segment the {x} field"),
    ("caption", "Describe the {x} scene"),
    ("caption", "Write a caption for the {x} picture"),
    ("caption", "Give an overview of the {x} region"),
    ("caption", "What is shown in the {x} photo?"),
    ("caption", "Summarize the first {x} image"),
    ("caption", "Tell me about the {x} tile"),
    ("caption", "What can you see at the {x}?"),
    ("vqa", "Is the {x} area rural or urban?"),
    ("vqa", "How many {x} ships are visible?"),
    ("vqa", "Are there {x} bridges in both images?"),
    ("vqa", "Is there a {x} canal?"),
    ("vqa", "Which crop fills the {x} plot?"),
    ("vqa", "What fraction of the {x} tile is water?"),
    ("vqa", "Does this image show a {x} mine?"),
    ("vqa", "How large is the {x} pond?"),
    ("vqa", "Count the {x} tanks"),
    ("vqa", "Average height of {x} trees"),
    ("vqa", "Land-cover type at the {x}"),
    ("vqa", "Expected {x} harvest"),
    ("grounding", "reservoir exactly {x}"),
    ("caption", "general {x} satellite contain going"),
    ("vqa", "crop grown {x} buildings"),
    ("change", "analyze change {x} coastline changed period"),
    ("vqa", "zzz {x} qqq"),
    ("vqa", "the {x}"),
]

#: (task, JSON result); ``{id}`` and ``{v}`` become the row id and its value.
PAYLOADS = [
    ("vqa", '{"text_response": "yes", "confidence": 0.5, "confidence_basis": "model_logprob", "evidence": {"id": {id}}}'),
    ("vqa", '{"text_response": "no", "confidence": {v}, "confidence_basis": "heuristic", "evidence": {}}'),
    ("vqa", '{"text_response": 7, "confidence": 1, "confidence_basis": "heuristic", "evidence": {}}'),
    ("caption", '{"text_response": "fields", "confidence": 0.25, "confidence_basis": "guess", "evidence": {}}'),
    ("caption", '{"text_response": "fields", "confidence": 0.25, "confidence_basis": "stub"}'),
    ("caption", '{"text_response": "fields", "confidence": 0.25, "confidence_basis": "stub", "evidence": [], "note": "x"}'),
    ("grounding", '{"text_response": "one", "bounding_boxes": [{"label": "a", "box_2d": [1, 2, 3, {v}], "confidence": 0.5}], "overlay_path": null, "confidence": 0.5, "confidence_basis": "heuristic"}'),
    ("grounding", '{"text_response": "one", "bounding_boxes": [{"label": "a", "box_2d": [9, 2, 3, 4], "confidence": 0.5}, {"label": "b", "box_2d": [1, 2, 3], "confidence": 2}], "overlay_path": "o.png", "confidence": 0.5, "confidence_basis": "heuristic"}'),
    ("grounding", '{"text_response": "none", "bounding_boxes": [], "overlay_path": 3, "confidence": 0, "confidence_basis": "heuristic"}'),
    ("change", '{"text_response": "c", "change_mask_path": "m{id}.png", "overlay_path": null, "metrics": {}, "confidence": 0.9, "confidence_basis": "calibrated", "evidence": {}}'),
    ("change", '{"text_response": "c", "change_mask_path": null, "overlay_path": "o{id}.png", "metrics": [], "confidence": true, "confidence_basis": "heuristic", "evidence": {}}'),
    ("fusion", '{"text_response": "f", "agreement_map_path": "a{id}.png", "overlay_path": "o{id}.png", "evidence": {}, "confidence": 0.7, "confidence_basis": "heuristic"}'),
    ("fusion", '{"text_response": "f", "agreement_map_path": null, "evidence": {}, "confidence": -0.1, "confidence_basis": "heuristic", "extra": 1}'),
]

#: Trace JSON, right and with one thing wrong.
_TRACE = (
    '{"run_id": "r{id}", "timestamp": "2026-01-01T00:00:00+00:00", "query": "q", "task_selected": "vqa", '
    '"routing": {"mechanism": "rule", "matched": "m", "score": 1.0, "alternatives_considered": []}, "inpu'
    'ts": [{"path": "a.tif", "modality": "sar", "bands": 1, "shape": [8, 8], "format": "GeoTIFF", "crs": '
    'null, "checks_passed": true}], "validation": {"passed": true, "warnings": [], "errors": []}, "models'
    '_used": [{"role": "vqa", "name": "n", "revision": "r", "precision": "p", "adapter": null, "device": '
    '"cpu"}], "parameters": {}, "result": {}, "artifacts": {"mask": null, "overlay": null, "report": null'
    '}, "timings_ms": {"routing": 1, "validation": 2, "inference": {v}, "total": 4}}'
)
TRACES = [_TRACE] + [_TRACE.replace(old, new) for old, new in [
    ('"task_selected": "vqa"', '"task_selected": "talk"'),
    ('"mechanism": "rule"', '"mechanism": "guess"'),
    ('"score": 1.0, "alternatives_considered": []', '"score": "1", "alternatives_considered": ["a", 2]'),
    ('"bands": 1, "shape": [8, 8]', '"bands": 1.5, "shape": [8]'),
    ('"crs": null, "checks_passed": true', '"crs": 4326, "checks_passed": "yes"'),
    ('"models_used": [{', '"models_used": [7, {"extra": 1, '),
    ('"parameters": {}, ', ''),
    ('"artifacts": {"mask": null, "overlay": null, "report": null}', '"artifacts": []'),
    ('"validation": {"passed": true, "warnings": [], "errors": []}', '"validation": {"passed": 1, "errors": [null]}'),
    ('"timings_ms": {"routing": 1', '"note": "x", "timings_ms": {"routing": true'),
]]
