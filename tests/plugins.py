"""Stand-ins for services: documents are pages between form feeds; a line `= level title` on a page is a mark."""


def outline(content):
    pages = content.decode().split("\f")
    if "unreadable" in pages[0]:
        raise ValueError
    marks = [(int(line.split()[1]), line.split(None, 2)[2], k + 1) for k, p in enumerate(pages) for line in p.split("\n") if line.startswith("= ")]
    return len(pages), marks


def split(content, start, end):
    return "\f".join(content.decode().split("\f")[start : end + 1]).encode()


def parse(content):
    text = content.decode()
    if "broken" in text:
        raise ValueError("broken page")
    return "\n\n".join(line for p in text.split("\f") for line in p.split("\n") if not line.startswith("= ")), {"p.png": b"image of " + text[:9].encode()}
