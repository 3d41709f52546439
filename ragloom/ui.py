"""Browser pages over the HTTP façade: a chat and the graph.  Needs streamlit, imported only here.

    streamlit run ragloom/ui.py -- http://127.0.0.1:8000
"""

from __future__ import annotations

import json
import sys
import urllib.error
import urllib.request

#: Seconds to wait for the state of the service, for an answer, and for the graph.
TIMEOUTS = {"status": 5, "query": 60, "graph/data": 10}


def call(base: str, page: str, body: dict | None = None, opener=urllib.request.urlopen) -> dict:
    """The reply as JSON; {"error": ...} if there is none."""
    data = json.dumps(body).encode() if body is not None else None
    request = urllib.request.Request(f"{base.rstrip('/')}/{page}", data, {"Content-Type": "application/json"})
    try:
        with opener(request, timeout=TIMEOUTS[page.partition("?")[0]]) as r:
            return json.load(r)
    except (OSError, ValueError, urllib.error.URLError) as e:
        return {"error": str(e)}


def dot(data: dict) -> str:
    """The graph in the DOT language."""
    quoted = lambda x: json.dumps(str(x), ensure_ascii=False)
    nodes = [f"  {quoted(n['id'])};" for n in data.get("nodes", [])]
    edges = [f"  {quoted(e['source'])} -> {quoted(e['target'])} [label={quoted(e['relation'])}];" for e in data.get("edges", [])]
    return "\n".join(["digraph {", *nodes, *edges, "}"])


def main(base: str) -> None:
    import streamlit as st

    page = st.sidebar.radio("Page", ("Chat", "Graph"))
    st.sidebar.json(call(base, "status"))
    if page == "Graph":
        st.graphviz_chart(dot(call(base, f"graph/data?limit={st.sidebar.slider('Relations', 10, 500, 100)}")))
        return
    method = st.sidebar.selectbox("Method", ("hybrid", "vector", "graph"))
    if question := st.chat_input("Question"):
        reply = call(base, "query", {"query": question, "method": method})
        st.chat_message("user").write(question)
        st.chat_message("assistant").write(reply.get("answer") or reply.get("error"))
        for source in reply.get("sources", []):
            with st.expander(f"{source['source']} {source['score']:.3f}"):
                st.write(source["content"])


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "http://127.0.0.1:8000")
