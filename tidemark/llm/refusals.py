"""A small classifier of sentences that decline a task, in several languages.

It is fitted on the example sentences below and, as sentences that decline nothing, on those of a bounded sample of
documents. What counts are the words and pairs of words (in Chinese: signs) of a sentence, without identifiers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

# Training rows: sentences that decline a task.
DECLINING = """
I'm sorry, but I can't help with this. I cannot assist with this request. I am unable to write this entry. I won't do this. I will not answer that question.
I'd prefer not to do this. I would rather not write about it. Sorry, I can't do that. That is not something I can do. This isn't something I'm able to help with.
I have to decline this request. I must refuse. No, I won't write it. As an AI model I can't produce this. As an assistant I am not able to do this.
My guidelines don't allow me to answer. This goes against my guidelines. I'm not allowed to share that. I don't feel comfortable writing this.
Unfortunately I can't complete this task. This falls outside what I can do. Request declined: unable to process this for policy reasons. Your request cannot be processed.
Please ask someone else about it. It would not be appropriate for me to describe this. I can't provide a summary of this. I'm not going to do this. I cannot comply with that.
I can't do this because it may contain personal data. No entry will be produced. My apologies, I can't do this for you. I won't be writing a diary. I decline.
Das kann ich nicht tun. Dabei kann ich leider nicht helfen. Ich werde das nicht schreiben. Ich darf das nicht beantworten. Das schreibe ich nicht.
Ich möchte das lieber nicht machen. Diese Anfrage muss ich ablehnen. Tut mir leid, das geht nicht. Das tue ich nicht. Ich weigere mich. Nein, so etwas mache ich nicht.
Dazu kann ich nichts sagen. Es tut mir leid, ich kann diesen Eintrag nicht erstellen. Meine Richtlinien erlauben das nicht. Bitte wende dich an jemand anderen.
Als Assistent kann ich das nicht zusammenfassen. Ich helfe dabei nicht. Das werde ich nicht machen.
No puedo hacer eso. No voy a escribir esto. Lo siento, no puedo ayudarte con eso. No me es posible resumirlo. Prefiero no hacerlo. Debo rechazar la petición. No haré eso.
Me niego a responder. No estoy autorizado a hacerlo. Mis normas no me lo permiten. Lamentablemente no puedo completar esta tarea. Como asistente no puedo escribir esta entrada.
Eso no lo puedo hacer. No quiero escribir sobre esto. Pregunta a otra persona. No voy a ayudar con eso.
我不能做这件事。我无法完成这个请求。抱歉，我帮不了你。我不会写这个。我拒绝回答。很抱歉，这个我做不了。作为助手，我不能总结这段会话。由于政策原因，我不能提供。
我不想写这个。这超出了我的能力范围。请找别人。恕我不能从命。我没办法协助。我不会这样做。
"""
# Training rows: sentences about things that failed, were refused or weren't done, which decline nothing.
REPORTING = """
You could not reproduce the bug. The server refused the connection. The build was not able to start. You declined the review and asked for tests. The upload was denied.
The request failed because the header was missing. I can't find the file, where is it? I could not run the tests yet. It can't connect to the host. The call was rejected by the proxy.
You told the team that you won't merge it. The worker was unable to read the lines. You can't open the report. I don't know why it fails. The request was declined by the reviewer.
Der Server konnte nicht starten. Du konntest den Fehler nicht nachstellen. Die Verbindung wurde abgelehnt. Der Test ist nicht grün. Das hast du nicht geändert. Ich finde die Datei nicht.
No pudiste reproducir el fallo. El servidor rechazó la conexión. La prueba no pasó. No encuentro el archivo. La petición fue rechazada por el proxy. No se pudo leer la línea.
你没有重现这个错误。服务器拒绝了连接。测试没有通过。我找不到这个文件。请求被代理拒绝了。这个不能合并。
"""

IDENTIFIER = re.compile(r"\S*[\d_/\\@=<>{}]\S*|\b\w+[.-]\w\S*|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z]+[A-Z]\w*")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n")
TOKEN = re.compile(r"[一-鿿]|[^\W\d_]+(?:['’][^\W\d_]+)?")
SURE = 0.25


def sentences(text: str) -> list[str]:
    return [s.strip() for s in SENTENCE_END.split(text) if TOKEN.search(s)]


def features(sentence: str) -> Iterator[str]:
    words = ["^", *(w.lower().replace("’", "'") for w in TOKEN.findall(IDENTIFIER.sub(" ", sentence))), "$"]
    yield from words[1:-1]
    yield from map(" ".join, zip(words, words[1:]))
    yield from map(" ".join, zip(words, words[1:], words[2:]))


def fit_refusals(others: Iterable[str]) -> dict[str, float]:
    """The weight of each feature: the log of how much oftener sentences that decline have it than others.

    A feature that no declining sentence has can only speak against.
    """
    told = [*sentences(REPORTING) * 20, *(s for t in others for s in sentences(t))]
    yes, no = Counter(), Counter()
    for s in sentences(DECLINING):
        yes.update(set(features(s)))
    for s in told:
        no.update(set(features(s)))
    a, b = len(sentences(DECLINING)), max(1, len(told))
    out = {}
    for f in yes.keys() | no.keys():
        w = math.log((yes[f] + 0.5) / (a + 1)) - math.log((no[f] + 0.5) / (b + 1))
        if yes[f] or w < 0:
            out[f] = round(w, 4)
    return out


def declining(sentence: str, weights: dict[str, float]) -> float:
    """How much a sentence reads as one that declines: the mean weight of its features, each within three.

    What was never seen counts as a little against it, so a few telling words don't outweigh a sentence about other things.
    """
    found = [max(-3.0, min(3.0, weights[f])) if f in weights else -0.5 for f in set(features(sentence))]
    return sum(found) / len(found) if found else -1.0


def declines(sentence: str, weights: dict[str, float]) -> bool:
    return declining(sentence, weights) >= SURE


def refused(text: str, weights: dict[str, float], share: float = 0.5) -> bool:
    """Whether at least ``share`` of a reply, by the length of its sentences, declines the task."""
    parts = sentences(text)
    whole = sum(map(len, parts))
    return whole > 0 and sum(len(s) for s in parts if declines(s, weights)) >= share * whole
