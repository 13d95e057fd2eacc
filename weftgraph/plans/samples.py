"""Small source files that the extraction queries read."""

FILES = {
    "shop/models.py": '''"""Models."""
import json
from dataclasses import dataclass

__all__ = ["Order", "total"]
RATE = 0.2


@dataclass
class Order:
    items: list

    def amount(self) -> float:
        return sum(self.price(i) for i in self.items)

    def price(self, item):
        return json.loads(item)["price"]


def total(orders: "list[Order]") -> float:
    return sum(o.amount() for o in orders)
''',
    "shop/service.py": """from shop.models import Order, total


class Base:
    def save(self):
        raise NotImplementedError


class Service(Base):
    def __init__(self, store):
        self.store = store

    def save(self, order: Order):
        self.check(order)
        return self.store.put_order(order)

    def check(self, order):
        def positive(x):
            return x > 0

        return positive(total([order]))


async def main():
    service = Service(None)
    service.save(Order([]))


main()
""",
    "web/cart.ts": """import { Item, Money as Cash } from './models';
import api from './api';

export interface Priced { price: Cash; }

export class Cart extends Base implements Priced {
  private items: Item[] = [];

  add(item: Item): void {
    // not(a) call
    if (item) { this.items.push(item); }
    api.send(render(item));
  }
}

export const render = (item: Item) => { return <Label text={item.name} />; };
export async function checkout(cart: Cart) { return submit(cart); }
type Id = string;
""",
    "web/util.js": "const fs = require('fs');\nexport function load(path) { return parse(fs.readText(path)); }\nclass Store extends Base { get(key) { return lookup(key); } }\n",
    "core/graph.rs": """use std::collections::{HashMap, HashSet};
use crate::node::Node;

#[derive(Debug)]
pub struct Graph { nodes: HashMap<u32, Node> }

pub trait Walk: Visit + Send { fn walk(&self); }

impl Walk for Graph {
    fn walk(&self) { visit_all(self.nodes.len()); }
}

pub const LIMIT: u32 = 10;
mod tests { }
""",
    "native/list.cpp": '#include "list.h"\n#include <vector>\nusing namespace std;\n\nnamespace app {\nclass List : public Base, private Impl {\n public:\n  int size() const { return count(items); }\n};\n}\n\nint total(int a, int b) { return add(a, b); }\n',
    "native/list.c": '#include "list.h"\n#define MAX 10\n\nstruct node { int value; };\n\nint push(struct node *n, int value) { return insert(n, value); }\n',
    "app/Main.java": """package app;
import java.util.List;
import static app.Util.*;

@Service
public class Main extends Base implements Runnable {
    private List<Order> orders;

    public Main(int n) { init(n); }

    @Override
    public void run() { process(orders); }
}
""",
}

BROKEN = {
    "broken/half.py": "import os\n\ndef good(x):\n    return x + 1\n\ndef bad(x:\n    return (x\n\nclass Open(\n\ndef after():\n    return 2\n",
    "broken/none.py": "x = (1,\ny ==== 2\n",
    "broken/whole.py": "def fine():\n    return 1\n",
}
