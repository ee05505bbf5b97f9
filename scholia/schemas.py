"""Record types of the engine.  Every ordered collection carries an explicit `ord`."""

from __future__ import annotations

FILE_TYPES = ("pdf", "docx", "pptx", "txt", "markdown", "image", "unknown")

DOCUMENT = (
    "id string, title string, source_path string, file_type string, content string, "
    "metadata map<string,string>, images array<string>, is_syllabus boolean"
)
CHUNK = "id string, document_id string, content string, position int"
TOPIC = (
    "ord int, name string, description string, related_documents array<string>, subtopic_count int, "
    "order_source string, syllabus_position int, missing_from_notes boolean, extra_in_notes boolean"
)
IMAGE = (
    "id string, source_document_id string, file_path string, page_or_slide int, caption string, "
    "ai_description string, width int, height int"
)
INDEX_ENTRY = "title string, anchor string, level int, ord int"
CHECK = "check string, status string, errors array<string>"
PROCESSING_STATE = (
    "content_hash string, source_path string, file_type string, parsed boolean, chunks_json string, "
    "topics_json string, model string, depth int, created_at timestamp, updated_at timestamp"
)
CACHE = "key string, prompt_preview string, response string, model string, created_at timestamp"

#: File suffixes by type.
SUFFIXES = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "pptx": "pptx", "ppt": "pptx", "txt": "txt", "md": "markdown",
    "markdown": "markdown", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image",
    "tiff": "image", "tif": "image", "webp": "image", "svg": "image",
}
#: Stems that name a syllabus.
SYLLABUS_WORDS = ("syllabus", "programma", "program", "course outline", "piano di studi")
