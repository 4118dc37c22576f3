"""Labels by which producers declare a block's layer; any other label declares nothing."""

LABELS = {
    "apparatus": "apparatus app-crit appcrit critical-apparatus",
    "heading": "heading ocr-title title",
    "notes": "notes",
    "page_number": "folio ocr-pageno page-number pageno",
    "running_head": "header ocr-header running-head",
    "translation": "facing-translation translation",
}
LAYER_OF = {label: layer for layer, labels in LABELS.items() for label in labels.split()}
