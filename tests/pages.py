"""Small pages of the shapes the engine has to handle, in markup of our own."""

BASE = "https://shop.example.test"


def cards():
    body = "".join(
        f'<article class="tile product" data-id="s{i}"><h2 class="label">Shelf {i}</h2><p class="about">Oak board no {i}</p>'
        f'<span class="price">${i + 10}.50</span><a href="/goods/{i}">More</a></article>' for i in range(8))
    return f"<main><h1>Shelves</h1><section id=grid>{body}</section></main>"


def table():
    """Berths of a harbour: a heading over three columns, two single ones, one of them with a line below it."""
    berths = [("North quay", "north@port.example", "0047 22 18 40", "Oslo", "840"), ("Inner basin", "basin@port.example", "0047 55 30 12", "Bergen", "1120"),
              ("Timber wharf", "wharf@port.example", "0047 73 99 01", "Trondheim", "95")]
    body = "".join(f"<tr><td>{name}</td><td>{mail}</td><td>{line}</td><td><em>{town}</em></td><td>{fee} EUR</td></tr>" for name, mail, line, town, fee in berths)
    return ("<table class=berths><thead><tr><th rowspan=2>Berth</th><th colspan=3>Agent</th><th>Fee</th></tr>"
            f"<tr><th>Mail</th><th>Line</th><th>Town</th><th>per night</th></tr></thead><tbody>{body}</tbody></table>")


def ads():
    """Notices that are built in two ways: pictures stand before the text or films behind it."""
    def notice(i):
        words = (f"<p>Library ID: N-{300 + 7 * i}</p><p class=when>Started running on {10 + i} March 2023</p>"
                 f'<a href="/firms/{i}"><b>Firm {"ABCDEF"[i]}</b></a><em>Sponsored</em><q>Crates of kind {i}, by the pallet</q>')
        if i % 3 == 0:
            return f'<li class="jsx-{i} notice"><img src="/pictures/{i}.png" alt="Crate {i}"><div>{words}</div></li>'
        return f'<li class="note_{i}{i}{i}{i} notice"><div>{words}</div><video src="/films/{i}.webm"></video></li>'

    return "<main><ul id=board>" + "".join(notice(i) for i in range(6)) + "</ul></main>"


def market():
    return "<section>" + "".join(
        f'<article class="offer"><a class="goods-name" href="/product/n-{i}">Grinder {i}</a>'
        f'<img src="/g{i}.jpg" alt="Grinder {i}"><span>₹ {1500 + i * 100}</span>'
        + ("" if i == 0 else f'<span class="moq">MOQ: {i + 1} Piece</span>')
        + f'<div data-label="Supplier">Supplier {i}</div><div aria-label="Location">Pune, India</div>'
        + (f"<span>4.{i} stars</span><span>{i * 10} reviews</span>" if i > 2 else "") + "</article>"
        for i in range(5)) + "</section>"


def duplicates():
    """Ferries, one of them listed twice, and a row without a name."""
    ferries = [("Kestrel", "Pier 204, deck 2048"), ("Heron", "Pier 77, deck 3101"), ("Kestrel", "Pier 204, deck 2048"), ("", "no pier")]
    return "<ol>" + "".join(f'<li class="entry line"><h2 class="label">{name}</h2><i class="place">{place}</i></li>' for name, place in ferries) + "</ol>"


def shadow():
    inner = "".join(f'<article class="tile"><h2 class="label">Hidden {i}</h2><span class="price">${i + 4}</span></article>'
                    for i in range(6))
    return (f'<main><h1>Shadow</h1><goods-grid><template shadowrootmode="open"><section class="goods">{inner}</section>'
            "</template></goods-grid></main>")


def frame_child():
    return '<section id="people">' + "".join(
        f'<article class="line"><h2 class="label">Studio {i}</h2><span class="phone">+1 555 100 200{i}</span></article>'
        for i in range(3)) + "</section>"


def frame():
    return '<main><h1>Embedded</h1><iframe src="frame-child" title="People"></iframe></main>'


def large(n=2000):
    """A ledger of many short entries, every fourth of them with a remark."""
    return "<dl id=ledger>" + "".join(
        f"<div class=entry><dt>Entry no {7 * i + 3}</dt><dd class=sum>{i % 90}.{i % 10}0 EUR</dd>" + (f"<dd class=remark>seen in week {i % 52}</dd>" if i % 4 == 0 else "")
        + "</div>" for i in range(n)) + "</dl>"


def signs():
    """Values that a spreadsheet would run."""
    return "<ul>" + "".join(f"<li><code class=cell>{value}</code><small>{note}</small></li>" for value, note in (
        ("@SUM(A1:A9)", "a sum"), ("=A2", "a link"), ("-B7", "a change of sign"), ("+C4*2", "a product"))) + "</ul>"


def private():
    return ('<article class=only><input class="secret" value="card-number"><div class="markup" onclick="go()">'
            'lead <span>Public</span> mid <input value="password"><b data-auth-token="s" class=k>Label &amp; x</b> tail'
            "<div hidden>gone<i>too</i></div><br></div></article>")


PAGES = {1: ("cards", cards()), 2: ("table", table()), 3: ("ads", ads()), 4: ("market", market()),
         5: ("duplicates", duplicates()), 6: ("shadow", shadow()), 7: ("frame", frame()),
         8: ("frame-child", frame_child()), 9: ("large", large()), 10: ("signs", signs()),
         11: ("private", private())}
ID = {name: number for number, (name, _) in PAGES.items()}


def pages_frame(spark):
    rows = [(number, f"{BASE}/{name}", f"<title>{name}</title>{html}") for number, (name, html) in PAGES.items()]
    return spark.createDataFrame(rows, "page_id long, url string, html string")
